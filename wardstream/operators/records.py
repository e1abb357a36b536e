"""The record pipeline: normalize, validate, deduplicate, enrich, harmonize, report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..session import small, written

#: Columns of a record and their types after normalization. Ports, counters and duration arrive as text.
RECORD = {
    "record_id": "string", "source": "string", "source_file": "string", "record_index": "bigint", "timestamp": "string", "src_ip": "string",
    "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "string", "duration": "double", "bytes_sent": "bigint",
    "bytes_recv": "bigint", "packets_sent": "bigint", "packets_recv": "bigint", "hostname": "string", "username": "string",
    "process_name": "string", "command_line": "string", "file_path": "string", "file_hash": "string", "source_label": "string",
    "attack_category": "string", "classification": "string", "severity": "string", "confidence": "double", "mitre_technique_id": "string",
    "mitre_technique_name": "string", "mitre_tactic": "string", "status": "string", "fingerprint": "string",
}
COUNTERS = ["bytes_sent", "bytes_recv", "packets_sent", "packets_recv"]


def as_records(df: DataFrame) -> DataFrame:
    """Fills the columns a record lacks: raw values stay text, confidence is 1.0, status raw, lists and tags empty."""
    have = set(df.columns)
    text = {c: "string" for c in (*COUNTERS, "src_port", "dst_port", "duration")}
    made = [F.col(c).cast("string").alias(c) if c in have and c in text else F.col(c) if c in have else F.lit({"confidence": 1.0, "status": "raw"}.get(c)).cast(text.get(c, t)).alias(c) for c, t in RECORD.items()]
    lists = {"normalization_actions": "array<string>", "validation_issues": "array<string>"}
    made += [F.col(c) if c in have else F.array().cast(t).alias(c) for c, t in lists.items()]
    tags = F.col("enrichment_tags") if "enrichment_tags" in have else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.select(*made, tags.alias("enrichment_tags"), *[c for c in df.columns if c not in RECORD and c not in lists and c != "enrichment_tags"])


def evaluated(df: DataFrame) -> DataFrame:
    """df with its columns computed once: later filters and projections are not merged into their expressions.

    The optimizer would copy a long expression into every use of its column. A filter on a non-deterministic id, which
    all rows pass, stops that without a shuffle or a materialisation. For batch frames only.
    """
    return df.withColumn("_once", F.monotonically_increasing_id()).filter("_once >= 0").drop("_once")


def normalize(df: DataFrame, ipv6: bool = True) -> DataFrame:
    """Field functions, types, and an action ``field: change`` for every value that changed, in a fixed order."""
    steps = [
        ("timestamp", S.record_timestamp(F.col("timestamp")), "normalized timestamp"),
        ("src_ip", S.record_ip(F.col("src_ip"), ipv6), "normalized ip"),
        ("dst_ip", S.record_ip(F.col("dst_ip"), ipv6), "normalized ip"),
        ("src_port", S.record_port(F.col("src_port")), "normalized port"),
        ("dst_port", S.record_port(F.col("dst_port")), "normalized port"),
        ("protocol", S.record_protocol(F.col("protocol")), "normalized protocol"),
        *[(c, S.collapse(F.col(c)), "normalized whitespace") for c in ("hostname", "username", "process_name", "command_line", "file_path")],
        ("file_hash", S.record_hash(F.col("file_hash")), "normalized hash"),
        ("severity", S.record_severity(F.col("severity")), "normalized severity"),
    ]
    change = [F.when(~new.cast("string").eqNullSafe(F.col(c).cast("string")), F.lit(f"{c}: {what}")) for c, new, what in steps]
    new = {c: e for c, e, _ in steps}
    # A counter that is no whole number, or negative, stays visible to validation through its _bad flag.
    number = {c: S.safe_long(F.col(c)) for c in COUNTERS} | {"duration": S.safe_double(F.col("duration"))}
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & (v.isNull() | (v < 0)), F.lit(c)) for c, v in number.items()]), lambda x: x.isNotNull())
    acts = F.concat("normalization_actions", F.filter(F.array(*change), lambda x: x.isNotNull()))
    status = F.when(F.col("status") == "raw", "normalized").otherwise(F.col("status"))
    return df.withColumns(new | number | {"normalization_actions": acts, "status": status, "_bad": bad})


def record_issues() -> Column:
    """Array of (code, message, field, severity), errors first, in the validator's order."""
    c = F.col

    def issue(when: Column, code: str, message: Column | str, field: str | None, severity: str = "error") -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message"), F.lit(field).cast("string").alias("field"), F.lit(severity).alias("severity")))

    blank = lambda x: c(x).isNull() | (c(x) == "")
    out = [issue(blank("record_id"), "missing_record_id", "record_id is required", "record_id"), issue(blank("source"), "missing_source", "source is required", "source")]
    for f in ("src_ip", "dst_ip"):
        out.append(issue(c(f).isNotNull() & ~c(f).rlike(r"^[0-9a-fA-F:.]+$"), "invalid_ip", F.concat(F.lit(f"{f} is not a valid IP address: "), c(f)), f))
    for f in ("src_port", "dst_port"):
        out.append(issue(~c(f).between(0, 65535), "invalid_port", F.concat(F.lit(f"{f} must be 0..65535, got "), c(f).cast("string")), f))
    for f in COUNTERS:
        out.append(issue((c(f) < 0) | F.array_contains("_bad", f), "invalid_numeric", f"{f} must be non-negative", f))
    out.append(issue((c("duration") < 0) | F.array_contains("_bad", "duration"), "invalid_duration", "duration must be non-negative", "duration"))
    out.append(issue(c("confidence").isNull() | F.isnan("confidence") | ~c("confidence").between(0.0, 1.0), "invalid_confidence", "confidence must be 0.0..1.0", "confidence"))
    for f, words in (("classification", vocab.CLASSIFICATIONS), ("severity", vocab.SEVERITIES), ("attack_category", vocab.ATTACK_CATEGORIES)):
        out.append(issue(~c(f).isin(words), f"invalid_{f}", F.concat(F.lit(f"invalid {f}: "), c(f)), f))
    out.append(issue(~c("file_hash").rlike("^[0-9a-f]{32,64}$"), "invalid_hash", "file_hash must be hex MD5/SHA-1/SHA-256", "file_hash"))
    out.append(issue(blank("timestamp"), "missing_timestamp", "timestamp could not be established", "timestamp", "warning"))
    out.append(issue(blank("source_label"), "missing_source_label", "no source label available for harmonization", "source_label", "warning"))
    context = [blank(f) for f in ("src_ip", "dst_ip", "hostname", "username", "process_name", "file_path")]
    out.append(issue(reduce(lambda a, b: a & b, context), "low_context", "record has no network or endpoint identifiers", None, "warning"))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def validate(df: DataFrame) -> DataFrame:
    """Adds ``issues``; any error rejects the record, else normalized becomes validated."""
    if "_bad" not in df.columns:
        df = df.withColumn("_bad", F.array().cast("array<string>"))
    df = df.withColumn("issues", record_issues())
    failed = F.exists("issues", lambda i: i["severity"] == "error")
    status = F.when(failed, "rejected").when(F.col("status") == "normalized", "validated").otherwise(F.col("status"))
    text = F.transform("issues", lambda i: F.concat(F.lit("["), i["severity"], F.lit("] "), i["code"], F.lit(": "), i["message"]))
    return df.withColumns({"status": status, "validation_issues": F.concat("validation_issues", text)}).drop("_bad")


def fingerprint(fields: list[str]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def deduplicate(df: DataFrame, fields: list[str] | None = None, order: str = "record_index", key: str = "record_id") -> DataFrame:
    """All rows with fingerprint, duplicate_of (the first row's key, in ``order``) and status duplicate for later ones.

    The first row of a fingerprint is found by a min-aggregation, which combines map-side, and joined back; a frequent
    fingerprint is a skewed join key, which adaptive execution splits, and never a window partition.
    """
    return first_of_each(df.withColumn("fingerprint", fingerprint(fields or vocab.EXACT_FIELDS)), order, key)


def first_of_each(df: DataFrame, order: str = "record_index", key: str = "record_id") -> DataFrame:
    """deduplicate() for rows that have their fingerprint.

    There are up to as many first rows as rows, so the join shuffles by hint: from the size of a compressed file the
    planner takes them for few and would send them through the driver.
    """
    live = F.col("status") != "rejected" if "status" in df.columns else F.lit(True)
    place = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    first = df.filter(live).groupBy("fingerprint").agg(F.min(place).alias("_first"))
    out = df.join(first.hint("merge"), "fingerprint", "left")
    later = live & (F.struct(F.col(order).alias("o"), F.col(key).alias("k")) != F.col("_first"))
    out = out.withColumn("duplicate_of", F.when(later, F.col("_first.k"))).drop("_first")
    return out.withColumn("status", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("status"))) if "status" in df.columns else out


def fifo_deduplicate(df: DataFrame, fields: list[str], limit: int, order: str = "record_index", key: str = "record_id", shards: int = 1) -> DataFrame:
    """Bounded window: the oldest of ``limit`` fingerprints is forgotten, and may then come again.

    Each decision hangs on all before it, so with one shard this is one ordered pass, by definition. With more, each shard
    of the fingerprints is a pass of its own that remembers limit / shards of them, as ``streams.unique_fifo`` does; the
    shards run side by side. Use deduplicate() for global deduplication. Adds fingerprint, duplicate_of and evictions (so far).
    """
    rows = df.withColumn("fingerprint", fingerprint(fields)).withColumn("s", F.pmod(F.xxhash64("fingerprint"), F.lit(shards)).cast("int"))
    narrow = rows.select(F.col(order).alias("o"), F.col(key).alias("k"), "fingerprint", "s")
    narrow = (narrow.repartition(1) if shards == 1 else narrow.repartition("s")).sortWithinPartitions("s", "o", "k")
    each = max(1, limit // shards)

    def run(batches):
        import collections

        import pandas as pd

        seen, shard, gone = collections.OrderedDict(), None, 0
        for b in batches:
            out = []
            for k, fp, s in zip(b["k"], b["fingerprint"], b["s"]):
                if s != shard:
                    seen, shard, gone = collections.OrderedDict(), s, 0
                first = seen.get(fp)
                if first is None:
                    seen[fp] = k
                    if len(seen) > each:
                        seen.popitem(last=False)
                        gone += 1
                out.append((k, fp, first, gone))
            yield pd.DataFrame(out, columns=["k", "fingerprint", "duplicate_of", "evictions"])

    kind = df.schema[key].dataType.simpleString()
    return narrow.mapInPandas(run, f"k {kind}, fingerprint string, duplicate_of {kind}, evictions bigint").withColumnRenamed("k", key)


def enrich(df: DataFrame, technique: bool = True, severity: bool = True, phase: bool = True) -> DataFrame:
    """Technique, severity and kill-chain phase of the attack category, with tags; validated becomes enriched.

    The tables have under twenty entries, so they are literal maps in the projection: no join, no shuffle.
    """
    cat = F.col("attack_category")
    real = cat.isNotNull() & (cat != "none")
    new, tags = {}, []
    if technique:
        tid = F.when(real, S.lookup(cat, vocab.CATEGORY_TECHNIQUE))
        names, tactics = {t: n for t, n, _ in vocab.TECHNIQUES}, {t: k for t, _, k in vocab.TECHNIQUES}
        new |= {
            "mitre_technique_id": F.coalesce(tid, "mitre_technique_id"),
            "mitre_technique_name": F.when(tid.isNotNull(), F.coalesce(S.lookup(tid, names), F.lit(""))).otherwise(F.col("mitre_technique_name")),
            "mitre_tactic": F.when(tid.isNotNull(), F.coalesce(S.lookup(tid, tactics), F.lit(""))).otherwise(F.col("mitre_tactic")),
        }
        tags.append(("mitre_source", F.when(tid.isNotNull(), F.lit("category_mapping"))))
    if severity:
        guess = F.col("severity").isNull() & cat.isNotNull()
        new["severity"] = F.when(guess, F.coalesce(S.lookup(cat, vocab.CATEGORY_SEVERITY), F.lit("medium"))).otherwise(F.col("severity"))
        tags.append(("severity_source", F.when(guess, F.lit("estimated_from_category"))))
    if phase:
        tags.append(("kill_chain_phase", F.when(real, S.lookup(cat, vocab.CATEGORY_PHASE))))
    new["enrichment_tags"] = with_tags(F.col("enrichment_tags"), tags)
    new["status"] = F.when(F.col("status") == "validated", "enriched").otherwise(F.col("status"))
    live = ~F.col("status").isin("rejected", "duplicate")
    return df.withColumns({c: F.when(live, e).otherwise(F.col(c)) for c, e in new.items()})


def with_tags(tags: Column, added: list[tuple[str, Column]]) -> Column:
    """The tags with the non-null ones of added over them."""
    names = [n for n, _ in added]
    fresh = F.map_filter(F.create_map(*[x for n, v in added for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    kept = F.map_filter(tags, lambda k, _: ~(k.isin(names) & F.map_contains_key(fresh, k)))
    return F.map_concat(kept, fresh)


def label_map(spark: SparkSession, extra: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(source, label, classification, attack_category, ord); ``extra`` rows (source, label, class, category) override."""
    override = {(s, lab): (c, a) for s, lab, c, a in extra}
    rows = [(s, lab, *override.pop((s, lab), (c, a))) for s, m in vocab.LABEL_MAPS.items() for lab, c, a in m]
    rows += [(s, lab, c, a) for (s, lab), (c, a) in override.items()]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, label string, classification string, attack_category string, ord int")


def label_overrides(text: str, source: str) -> list[tuple[str, str, str, str]]:
    """Rows for label_map from the YAML text of a label file, whose name is the source's.

    ``labels`` maps a label to its classification and attack_category (unknown ones become suspicious and other), or to a
    classification alone (an unknown one is left out, the category is other).
    """
    doc = _yaml(text)
    labels = doc.get("labels", doc) if isinstance(doc, dict) else None
    rows = []
    for label, held in labels.items() if isinstance(labels, dict) else ():
        if isinstance(held, dict):
            cls, category = held.get("classification", "suspicious"), held.get("attack_category", "other")
            rows.append((source, str(label), cls if cls in vocab.CLASSIFICATIONS else "suspicious", category if category in vocab.ATTACK_CATEGORIES else "other"))
        elif isinstance(held, str) and held in vocab.CLASSIFICATIONS:
            rows.append((source, str(label), held, "other"))
    return rows


def _yaml(text: str) -> dict:
    """Nested mappings of plain scalars; the optional package yaml reads more."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass
    root: dict = {}
    open_at = [(-1, root)]
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#") or ":" not in body:
            continue
        depth = len(line) - len(line.lstrip())
        while depth <= open_at[-1][0]:
            open_at.pop()
        key, _, value = body.rpartition(":") if body.endswith(":") else body.partition(": ")
        key, value = (x.strip().strip("\"'") for x in (key, value))
        if value:
            open_at[-1][1][key] = value
        else:
            open_at[-1][1][key] = {}
            open_at.append((depth, open_at[-1][1][key]))
    return root


def resolve_labels(labels: DataFrame, maps: DataFrame) -> DataFrame:
    """Distinct (source, source_label) with match_kind (mapped, ambiguous, unknown), class, category and matched label.

    Exact match, then case-insensitive, then containment either way; the first in map order wins. The containment
    search is a join without an equality, so it runs over distinct labels, never over rows.
    """
    m = small(maps.select(F.col("source").alias("_s"), F.col("label").alias("_l"), F.col("classification").alias("_c"), F.col("attack_category").alias("_a"), "ord"))
    low, key = F.lower("source_label"), F.lower("_l")
    level = F.when(F.col("source_label") == F.col("_l"), 0).when(low == key, 1).otherwise(2)
    hit = (F.col("source") == F.col("_s")) & (low.contains(key) | key.contains(low))
    best = F.min(F.when(F.col("_l").isNotNull(), F.struct(level.alias("level"), "ord", "_l", "_c", "_a"))).alias("b")
    found = labels.join(m, hit, "left").groupBy("source", "source_label").agg(best)
    kind = F.when(F.col("b").isNull(), "unknown").when(F.col("b.level") < 2, "mapped").otherwise("ambiguous")
    return found.select("source", "source_label", kind.alias("match_kind"), F.col("b._c").alias("_class"), F.col("b._a").alias("_category"), F.col("b._l").alias("_label"))


def harmonize(df: DataFrame, maps: DataFrame) -> DataFrame:
    """One taxonomy for all sources: class, category, confidence, tags and status as the label's match calls for."""
    distinct = df.filter("source_label is not null").select("source", "source_label").distinct()
    found = resolve_labels(distinct, maps)
    out = df.join(found, ["source", "source_label"], "left")
    kind = F.when(F.col("source_label").isNull(), "no_label").otherwise(F.coalesce("match_kind", F.lit("unknown")))
    open_status = F.col("status").isin("enriched", "validated")
    live = ~F.col("status").isin("rejected", "duplicate")
    review = kind.isin("ambiguous", "unknown")
    tags = [("harmonization", kind), ("ambiguous_label", F.when(kind == "ambiguous", F.col("source_label"))), ("ambiguous_match_key", F.when(kind == "ambiguous", F.col("_label"))), ("unmapped_label", F.when(kind == "unknown", F.col("source_label")))]
    new = {
        "classification": F.when(kind == "mapped", F.col("_class")).when(review, "review_required").otherwise("insufficient_evidence"),
        "attack_category": F.when(kind == "mapped", F.col("_category")).otherwise("other"),
        "confidence": F.when(kind == "ambiguous", 0.2).when(kind == "unknown", 0.0).otherwise(F.col("confidence")),
        "enrichment_tags": with_tags(F.col("enrichment_tags"), tags),
        "status": F.when(open_status, F.when(review, "review_required").otherwise("harmonized")).otherwise(F.col("status")),
    }
    return out.withColumns({c: F.when(live, e).otherwise(F.col(c)) for c, e in new.items()}).drop("match_kind", "_class", "_category", "_label")


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines as written by the sink, typed; blank lines are skipped, a field that is absent is null."""
    lists = "normalization_actions array<string>, validation_issues array<string>, enrichment_tags map<string,string>"
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in RECORD.items()) + f", {lists}").json(path)


def run_pipeline(
    df: DataFrame, maps: DataFrame, near: bool = False, harmonize_first: bool = False, ipv6: bool = True, steps: list[Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """Every row with its outcome in ``status``; rejected and duplicate rows skip the later steps.

    The default order enriches before it harmonizes, as the source semantics have it; ``harmonize_first`` lets the
    harmonized category drive the enrichment. ``steps`` (functions of a frame, which must keep every row) take the place
    of both.
    """
    out = as_records(df).transform(lambda d: normalize(d, ipv6)).transform(evaluated).transform(validate)
    out = out.withColumn("fingerprint", fingerprint(vocab.NEAR_FIELDS if near else vocab.EXACT_FIELDS))
    out = first_of_each(written(out, "records"))  # the search for first rows reads four columns of it, the rest goes on
    if steps is None:
        steps = [enrich, lambda d: harmonize(d, maps)]
        steps = steps[::-1] if harmonize_first else steps
    for step in steps:
        out = out.transform(evaluated).transform(step)
    return out


def pipeline_report(out: DataFrame) -> DataFrame:
    """One row of counters over the outcomes."""
    gone = F.col("status").isin("rejected", "duplicate")
    count = lambda severity: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == severity))).cast("bigint")
    return out.agg(
        F.count("*").alias("input_records"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(~gone).alias("output_records"), count("error").alias("errors"), count("warning").alias("warnings"),
        F.count_if(~gone & (F.size("enrichment_tags") > 0)).alias("enriched"), F.count_if(F.col("status") == "harmonized").alias("harmonized"),
        F.count_if(F.col("status") == "review_required").alias("review_required"),
    )


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
