"""Canonical events: field discovery, type inference, normalization, validation, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..session import written
from .records import evaluated

TEXT_FIELDS = ["hostname", "username", "domain", "process_name", "command_line", "file_path", "file_hash", "protocol", "status"]


def event_type(mapped: dict[str, Column]) -> Column:
    """Category of an event: its own hint if known, else what its fields and words suggest."""
    some = lambda *names: reduce(lambda a, b: a | b, [F.coalesce(mapped[n] != "", F.lit(False)) for n in names])
    hint = F.lower(mapped["_event_type"])

    def by_words(joined: Column) -> Column:
        says = lambda words: reduce(lambda a, b: a | b, [joined.contains(w) for w in words])
        return (
            F.when(says(vocab.AUTH_TOKENS), "authentication")
            .when(says(vocab.REGISTRY_TOKENS), "registry_modification")
            .when(mapped["file_path"].isNotNull() | says(vocab.FILE_TOKENS), "file_modification")
            .when(says(vocab.WEB_TOKENS), "web_request")
            .otherwise("generic")
        )

    return (
        F.when(hint.isin(vocab.EVENT_TYPES), hint)
        .when(some("process_name", "command_line"), "process_creation")
        .when(some("source_ip", "dest_ip"), "network_connection")
        .when(mapped["domain"].isNotNull(), "dns_query")
        .otherwise(S.let(F.lower(F.concat_ws(" ", *mapped.values())), by_words))
    )


def canonicalize(df: DataFrame, ipv6: bool = True) -> DataFrame:
    """Events from rows (event_id, source_name, source_format, record_index, raw JSON text).

    The object is flattened to dotted paths; invalid addresses and ports are kept as ``_invalid_*`` attributes.
    """
    # Each key is reduced and looked up once, where the text is read; the fields and the attributes both come from that.
    df = df.withColumn("_e", S.event_entries("raw"))
    fields = list(vocab.FIELD_ALIASES)
    m = {f: F.col("_e.known")[i] for i, f in enumerate(fields)}
    df = df.withColumns({f"_{f}_text": m[f] for f in ("source_ip", "dest_ip")})
    ips = {f"_{f}": S.event_ip(F.col(f"_{f}_text"), ipv6) for f in ("source_ip", "dest_ip")}
    df = df.withColumns(ips | {"_timestamp": S.event_timestamp(m["timestamp"])})
    typed = {"source_ip": F.col("_source_ip"), "dest_ip": F.col("_dest_ip"), "port": S.safe_long(m["port"]).cast("int"), "dest_port": S.safe_long(m["dest_port"]).cast("int")}
    invalid = [x for f, v in typed.items() for x in (F.lit(f"_invalid_{f}"), F.when(m[f].isNotNull() & (m[f] != "") & v.isNull(), m[f]))]
    odd = F.when(F.col("_timestamp").isNull() & (m["timestamp"] != ""), m["timestamp"])
    invalid += [F.lit("_unparsed_timestamp"), odd]
    attributes = F.map_concat("_e.rest", F.map_filter(F.create_map(*invalid), lambda k, v: v.isNotNull()))
    text = {f: F.nullif(S.strip(m[f]), F.lit("")) for f in TEXT_FIELDS}
    return df.select(
        "event_id", "source_name", "source_format", "record_index", F.col("_timestamp").alias("timestamp"), event_type(m).alias("event_type"),
        *[v.alias(f) for f, v in (text | typed).items()], S.event_severity(m["severity"]).alias("severity"), "raw", attributes.alias("attributes"),
    )


def normalize(df: DataFrame) -> DataFrame:
    """Canonical text of every field; a value whose function gives null is kept. Attribute text is collapsed."""
    how = {"hostname": S.event_lower, "domain": S.event_domain, "protocol": S.event_lower, "file_hash": S.event_lower, "status": S.event_status}
    new = {f: F.coalesce(how.get(f, S.collapse)(F.col(f)), F.col(f)) for f in TEXT_FIELDS}
    acts = F.array(*[F.when(~v.eqNullSafe(F.col(f)), F.lit(f"{f}: normalized")) for f, v in new.items()])
    spaced = F.transform_values("attributes", lambda k, v: F.coalesce(S.collapse(v), v))
    return df.withColumns(new | {"attributes": spaced, "normalization_actions": F.filter(acts, lambda x: x.isNotNull())})


def light_issues() -> Column:
    """Array of texts of the four structural checks of one event."""
    c = F.col
    return F.array_compact(F.array(
        F.when(F.coalesce(c("event_id"), F.lit("")) == "", "missing event_id"), F.when(c("source_format") == "unknown", "unknown source format"),
        F.when(~F.coalesce(c("event_type").isin(vocab.EVENT_TYPES), F.lit(False)), F.concat(F.lit("unrecognized event_type: "), F.coalesce("event_type", F.lit("none")))),
        F.when((c("severity") != "") & ~c("severity").isin(vocab.SEVERITIES), F.concat(F.lit("unrecognized severity: "), "severity")),
    ))


def validate(df: DataFrame) -> DataFrame:
    """Adds ``issues`` (code, field, severity) and validation_status."""
    c = F.col
    has = lambda k: F.map_contains_key("attributes", k)
    blank = lambda x: c(x).isNull() | (c(x) == "")
    found: list[tuple[Column, str, str | None, str]] = [
        (blank("event_id"), "missing_event_id", "event_id", "error"),
        (blank("source_name"), "missing_source_name", "source_name", "error"),
        (c("source_format") == "unknown", "unknown_source_format", "source_format", "error"),
        (~c("event_type").isin(vocab.EVENT_TYPES), "invalid_event_type", "event_type", "error"),
        (~c("severity").isin(vocab.SEVERITIES), "invalid_severity", "severity", "error"),
        *[(has(f"_invalid_{f}"), "invalid_ip", f"_invalid_{f}", "error") for f in ("source_ip", "dest_ip")],
        *[x for f in ("port", "dest_port") for x in ((~c(f).between(0, 65535), "invalid_port", f, "error"), (has(f"_invalid_{f}"), "invalid_port", f, "error"))],
        (c("file_hash").isNotNull() & S.hash_algorithm(c("file_hash")).isNull(), "invalid_hash", "file_hash", "error"),
        (~c("protocol").isin(vocab.EVENT_PROTOCOLS), "unknown_protocol", "protocol", "warning"),
        (F.coalesce(F.get_json_object("raw", "$._parse_error"), F.lit("")) != "", "source_parse_error", "raw", "error"),
        (blank("timestamp"), "missing_timestamp", "timestamp", "warning"),
        (c("event_type") == "generic", "generic_event_type", "event_type", "warning"),
        (reduce(lambda a, b: a & b, [blank(f) for f in ("hostname", "username", "source_ip", "dest_ip", "domain", "process_name", "file_path")]), "low_context", None, "warning"),
    ]
    rows = [F.when(w, F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), F.lit(sev).alias("severity"))) for w, code, field, sev in found]
    df = df.withColumn("issues", F.filter(F.array(*rows), lambda x: x.isNotNull()))
    state = F.when(F.exists("issues", lambda i: i["severity"] == "error"), "invalid").when(F.size("issues") > 0, "valid_with_warnings").otherwise("valid")
    return df.withColumn("validation_status", state)


def fingerprint() -> Column:
    """SHA-256 of the event's fields as JSON, attributes in the order of their keys."""
    sorted_attributes = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes"))))
    plain = [f for f in vocab.EVENT_FIELDS if f != "attributes"]
    text = F.to_json(F.struct(*sorted(plain), sorted_attributes.alias("attributes")), {"ignoreNullFields": "false"})
    return F.sha2(text, 256)


def deduplicate(df: DataFrame) -> DataFrame:
    """Adds fingerprint (if it is not there yet), duplicate_of and status (trusted, rejected, duplicate) over the valid events.

    The join shuffles by hint, as that of ``records.first_of_each`` does.
    """
    df = df if "fingerprint" in df.columns else df.withColumn("fingerprint", fingerprint())
    place = F.struct(F.col("record_index").alias("o"), F.col("event_id").alias("k"))
    first = df.filter("validation_status <> 'invalid'").groupBy("fingerprint").agg(F.min(place).alias("_f"))
    out = df.join(first.hint("merge"), "fingerprint", "left")
    later = (F.col("validation_status") != "invalid") & (F.struct(F.col("record_index").alias("o"), F.col("event_id").alias("k")) != F.col("_f"))
    out = out.withColumn("duplicate_of", F.when(later, F.col("_f.k"))).drop("_f")
    status = F.when(F.col("validation_status") == "invalid", "rejected").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("trusted")
    return out.withColumn("status", status)


def process(df: DataFrame, ipv6: bool = True) -> DataFrame:
    """All outcomes of the raw rows; filter on ``status = 'trusted'`` for what goes on."""
    for step in (lambda d: canonicalize(d, ipv6), normalize):
        df = df.transform(step).transform(evaluated)
    return deduplicate(written(validate(df).withColumn("fingerprint", fingerprint()), "events"))


def alert_input(df: DataFrame) -> DataFrame:
    """The event as a triage alert: alert, context and one evidence item."""
    title = F.concat_ws(" ", F.initcap(F.translate("event_type", "_", " ")), F.lit("on"), F.coalesce("hostname", "source_ip", F.lit("unknown host")))
    evidence = F.struct(
        F.format_string("EVT-%06d", F.col("record_index") + 1).alias("id"),
        F.when(F.col("event_type") == "generic", "process_creation").otherwise(F.col("event_type")).alias("type"),
        F.concat_ws("; ", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in (*TEXT_FIELDS, "source_ip", "dest_ip", "port")]).alias("description"),
        F.col("timestamp"),
    )
    alert = F.struct(title.alias("title"), F.coalesce("severity", F.lit("medium")).alias("severity"), F.col("source_name").alias("source"), "timestamp")
    return df.select("event_id", alert.alias("alert"), F.struct("hostname", "username", F.col("source_ip").alias("ip_address")).alias("context"), F.array(evidence).alias("evidence"))
