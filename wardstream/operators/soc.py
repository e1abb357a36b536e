"""The nested triage record: parsing, validation, strict loading, chat examples, fingerprints.

A record is one JSON object: id, task, input (alert, context, evidence), output and metadata. Parsed records are typed
structs, in which a field that is missing and one that is null are the same; a field of another type than its own is listed
in ``wrong_types``, which reads the record without a schema. Every check is an expression over one row,
so a record is validated where it is read; only the search for repeated ids shuffles, and it shuffles ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.scalars import let, sorted_json, strip
from ..session import small
from .records import evaluated
from .training import highest_severity

#: raw_data keeps its JSON text.
SCHEMA = (
    "id string, task string, "
    "input struct<alert: struct<title: string, description: string, severity: string, source: string, timestamp: string, rule_name: string, rule_id: string>, "
    "context: struct<hostname: string, username: string, ip_address: string, department: string, asset_criticality: string, environment: string, os: string>, "
    "evidence: array<struct<id: string, type: string, description: string, timestamp: string, raw_data: string>>>, "
    "output struct<classification: string, confidence: double, severity: string, findings: array<struct<description: string, evidence_refs: array<string>, severity: string>>, rationale: string, "
    "mitre_techniques: array<struct<technique_id: string, technique_name: string, tactic: string, evidence_refs: array<string>>>, "
    "recommended_actions: array<struct<action: string, priority: string, rationale: string>>, investigation_steps: array<struct<step: string, purpose: string>>, summary: string>, "
    "metadata struct<source: string, generator: string, review_status: string, dataset_version: string, quality_score: int, template_id: string, split: string, borderline_category: string>"
)


#: Types that fields must have, as Spark names a variant's; a truth value counts as a number.
_OBJECT, _ARRAY, _TEXT, _NUMBER = ["OBJECT"], ["ARRAY"], ["STRING"], ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"]
FIELD_TYPES = {
    "id": _TEXT, "input": _OBJECT, "input.alert": _OBJECT, "input.context": _OBJECT, "input.evidence": _ARRAY,
    "output": _OBJECT, "output.confidence": _NUMBER, "output.findings": _ARRAY, "metadata": _OBJECT,
}
#: Arrays whose items must be objects.
ITEM_TYPES = ("input.evidence", "output.findings")


def _kind(v: Column) -> Column:
    """The type of a variant without what it holds (OBJECT, ARRAY, STRING, ...); null for an absent one."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def wrong_types(raw: str = "raw") -> Column:
    """Paths of a record's JSON text at which a value has the wrong type, outer ones first; what is absent or null has none.

    Of a value that is wrong itself nothing inside is judged. Text that is no JSON gives null, JSON that is no object ``$``.
    """

    def paths(v: Column) -> Column:
        field = lambda path, kinds: F.when(~_kind(F.try_variant_get(v, f"$.{path}", "variant")).isin([*kinds, "VOID"]), F.lit(path))
        item = lambda path: F.transform(
            F.try_variant_get(v, f"$.{path}", "array<variant>"), lambda x, i: F.when(F.coalesce(_kind(x), F.lit("VOID")) != "OBJECT", F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))),
        )
        none = F.array().cast("array<string>")
        inside = F.array_compact(F.concat(F.array(*[field(p, k) for p, k in FIELD_TYPES.items()]), *[F.coalesce(item(p), none) for p in ITEM_TYPES]))
        return F.when(_kind(v) == "OBJECT", inside).otherwise(F.array(F.lit("$")))

    return let(F.try_parse_json(raw), lambda v: F.when(v.isNotNull(), paths(v)))


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The rows with the fields of their JSON text, and wrong_types; text that is no JSON object gives null fields.

    An item of the wrong type in an array of objects is null, its neighbours are kept.
    """
    fields = T.StructType.fromDDL(SCHEMA)

    def mended(x: Column, block: str, array: str) -> Column:
        kind = fields[block].dataType[array].dataType.simpleString()
        items = F.try_variant_get(x["v"], f"$.{block}.{array}", kind)
        wrong = F.coalesce(x["w"], F.array().cast("array<string>"))
        return F.when(F.exists(wrong, lambda p: p.startswith(f"{block}.{array}[")), x["r"][block].withField(array, items)).otherwise(x["r"][block])

    def sure(x: Column) -> Column:
        truth = F.try_variant_get(x["v"], "$.output.confidence", "boolean").cast("double")
        output = F.when(x["o"]["confidence"].isNull() & truth.isNotNull(), x["o"].withField("confidence", truth)).otherwise(x["o"])
        return F.struct(x["r"].withField("input", x["i"]).withField("output", output).alias("r"), x["w"].alias("w"))

    # Each part is bound once, and none is merged into what reads it: copied into every use, the text would be parsed for each.
    parts = F.struct(F.from_json(raw, SCHEMA).alias("r"), F.try_parse_json(raw).alias("v"), wrong_types(raw).alias("w"))
    both = lambda x: F.struct(x["r"].alias("r"), x["v"].alias("v"), x["w"].alias("w"), mended(x, "input", "evidence").alias("i"), mended(x, "output", "findings").alias("o"))
    out = df.withColumn("_p", let(let(parts, both), sure)).transform(evaluated)
    return out.select("*", "_p.r.*", F.col("_p.w").alias("wrong_types")).drop("_p")


def _issue(when: Column, code: str, at: Column | str | None = None, severity: str = "error") -> Column:
    place = F.lit(at).cast("string") if at is None or isinstance(at, str) else at
    return F.array_compact(F.array(F.when(when, F.struct(F.lit(code).alias("code"), place.alias("at"), F.lit(severity).alias("severity")))))


def _each(items: Column, prefix: str, checks) -> Column:
    """Issues of the items of an array: checks(item, path) gives their arrays; a missing array or item has none."""
    none = F.array().cast("array<struct<code:string,at:string,severity:string>>")
    found = F.flatten(F.transform(items, lambda x, i: F.when(x.isNull(), none).otherwise(F.concat(*checks(x, F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit("]")))))))
    return F.coalesce(found, none)


def _repeats(values: Column) -> Column:
    """The values that stand earlier in the array too, once for each repeat."""
    return F.filter(F.transform(values, lambda v, i: F.when(F.array_position(values, v) <= i, v)), lambda v: v.isNotNull())


def issues(known_techniques: list[str] | None = None) -> Column:
    """Array of (code, at, severity) of a parsed record: structure first, then references, then coherence (warnings)."""
    c = F.col
    known = vocab.TECHNIQUES if known_techniques is None else known_techniques
    known = [t if isinstance(t, str) else t[0] for t in known]
    ids = F.coalesce(F.array_compact(F.transform("input.evidence", lambda e: e["id"])), F.array().cast("array<string>"))
    blank = lambda x: strip(x) == ""
    wrong = F.coalesce("wrong_types", F.array().cast("array<string>"))
    # Below a value of the wrong type there is nothing to miss.
    above = lambda path: [".".join(path.split(".")[:n]) for n in range(1, path.count(".") + 2)]
    missing = lambda path: _issue(c(path).isNull() & ~F.arrays_overlap(wrong, F.array(*[F.lit(p) for p in above(path)])), "missing_field", path)
    right = lambda path: ~F.array_contains(wrong, path)

    def refs(x: Column, at: Column, empty: bool) -> list[Column]:
        strange = F.exists(x["evidence_refs"], lambda r: ~F.array_contains(ids, r))
        some = [_issue(F.size(x["evidence_refs"]) == 0, "empty_evidence_refs", at)] if empty else []
        return [*some, _issue(strange, "unknown_evidence_ref", at)]

    evidence = lambda e, at: [
        *[_issue(e[f].isNull(), "missing_field", F.concat(at, F.lit(f".{f}"))) for f in ("id", "type", "description")],
        _issue((e["id"] != "") & ~e["id"].rlike(vocab.EVIDENCE_ID), "invalid_evidence_id", at),
        _issue(~e["type"].isin(vocab.EVIDENCE_TYPES), "invalid_evidence_type", at),
    ]
    finding = lambda f, at: [
        *[_issue(f[x].isNull(), "missing_field", F.concat(at, F.lit(f".{x}"))) for x in ("description", "evidence_refs")], *refs(f, at, True),
    ]
    technique = lambda t, at: [
        _issue((t["technique_id"] != "") & ~t["technique_id"].rlike(vocab.TECHNIQUE_ID), "invalid_technique_id", at),
        _issue((t["technique_id"] != "") & ~t["technique_id"].isin(known), "technique_not_in_reference", at, "warning") if known else F.array().cast("array<struct<code:string,at:string,severity:string>>"),
        *refs(t, at, False),
    ]
    stamps = F.filter(F.transform("input.evidence", lambda e: F.try_to_timestamp(e["timestamp"])), lambda t: t.isNotNull())
    cls, conf = c("output.classification"), c("output.confidence")
    return F.concat(
        _each(F.filter(wrong, lambda p: p != "$"), "wrong", lambda path, at: [_issue(path.isNotNull(), "wrong_type", path)]),
        *[missing(f) for f in ("id", "task", "input", "output", "metadata")],
        _issue(~c("id").rlike(vocab.SOC_ID) & right("id"), "invalid_id", "id"), _issue(~c("task").isin(vocab.SOC_TASKS), "invalid_task", "task"),
        *[F.when(c("input").isNotNull(), missing(f"input.{f}")).otherwise(_issue(F.lit(False), "")) for f in ("alert", "context", "evidence")],
        *[F.when(c("input.alert").isNotNull(), F.concat(missing(f"input.alert.{f}"), _issue(blank(c(f"input.alert.{f}")), "empty_field", f"input.alert.{f}"))).otherwise(_issue(F.lit(False), "")) for f in ("title", "severity", "source")],
        _issue(~c("input.alert.severity").isin(vocab.SEVERITIES), "invalid_alert_severity", "input.alert.severity"),
        _issue(F.size("input.evidence") == 0, "empty_evidence", "input.evidence"),
        _each(c("input.evidence"), "input.evidence", evidence),
        _each(_repeats(ids), "repeat", lambda v, at: [_issue(v.isNotNull(), "duplicate_evidence_id", v)]),
        *[F.when(c("output").isNotNull(), missing(f"output.{f}")).otherwise(_issue(F.lit(False), "")) for f in ("classification", "confidence", "findings")],
        _issue(~cls.isin(vocab.SOC_CLASSIFICATIONS), "invalid_classification", "output.classification"),
        _issue(~conf.between(0.0, 1.0), "confidence_out_of_range", "output.confidence"),
        _issue(F.size("output.findings") == 0, "empty_findings", "output.findings"),
        _each(c("output.findings"), "output.findings", finding), _each(c("output.mitre_techniques"), "output.mitre_techniques", technique),
        *[F.when(c("metadata").isNotNull(), missing(f"metadata.{f}")).otherwise(_issue(F.lit(False), "")) for f in ("source", "generator", "review_status", "dataset_version")],
        _issue(c("metadata.source") != "synthetic", "invalid_source", "metadata.source"),
        _issue(~c("metadata.review_status").isin(vocab.REVIEW_STATUSES), "invalid_review_status", "metadata.review_status"),
        _issue(stamps != F.array_sort(stamps), "evidence_out_of_order", "input.evidence", "warning"),
        _issue((cls == "confirmed_malicious") & (conf < 0.70), "low_confidence", "output.confidence", "warning"),
        _issue((cls == "benign") & (conf < 0.60), "low_confidence", "output.confidence", "warning"),
        _issue((cls == "benign") & (c("input.alert.severity") == "critical"), "critical_but_benign", "input.alert.severity", "warning"),
        _issue(c("metadata.quality_score") < 70, "low_quality_score", "metadata.quality_score", "warning"),
    )


def validate(df: DataFrame, strict: bool = False, known_techniques: list[str] | None = None) -> DataFrame:
    """Parsed records with issues and valid; ``strict`` makes every warning an error, marked ``[strict]`` in its code.

    An id that stands on several records is an error of each of them. Counting ids shuffles ids only, pre-added in the
    tasks; a frequent one is a skewed join key, which adaptive execution splits.
    """
    found = issues(known_techniques)
    if "wrong_types" not in df.columns:  # records that were typed from the start
        df = df.withColumn("wrong_types", F.array().cast("array<string>"))
    repeated = df.filter("id is not null").groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1")
    out = df.withColumn("issues", found).join(repeated, "id", "left")
    again = _issue(F.col("_n") > 1, "duplicate_id", "id")
    out = out.withColumn("issues", F.concat("issues", again)).drop("_n")
    if strict:
        hard = lambda i: F.struct(F.when(i["severity"] == "warning", F.concat(F.lit("[strict] "), i["code"])).otherwise(i["code"]).alias("code"), i["at"].alias("at"), F.lit("error").alias("severity"))
        out = out.withColumn("issues", F.transform("issues", hard))
    return out.withColumn("valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def summary(validated: DataFrame) -> DataFrame:
    """(code, severity, n): how often each issue occurs."""
    each = validated.select(F.explode("issues").alias("i"))
    return each.groupBy(F.col("i.code").alias("code"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))


class InvalidRecords(ValueError):
    """The held-out set breaks a rule."""


def load_held_out(df: DataFrame, raw: str = "raw", expected: int | None = None) -> DataFrame:
    """The parsed records of a held-out set, or InvalidRecords on the first rule that any row breaks.

    Rules in order: JSON objects only, top-level, input and output keys there, known classification, known alert
    severity (if there is one), no id twice, and exactly ``expected`` records if a number is given.
    """
    rows = parse(df.filter(strip(F.col(raw)) != ""), raw)
    c = F.col
    broken = {
        "not a JSON object": F.try_parse_json(raw).isNull() | ~strip(c(raw)).startswith("{"),
        "missing key": c("id").isNull() | c("task").isNull() | c("input").isNull() | c("output").isNull() | c("metadata").isNull(),
        "missing input key": c("input.alert").isNull() | c("input.context").isNull() | c("input.evidence").isNull(),
        "missing output key": c("output.classification").isNull() | c("output.confidence").isNull() | c("output.findings").isNull(),
        "invalid classification": ~c("output.classification").isin(vocab.SOC_CLASSIFICATIONS),
        "invalid alert severity": (c("input.alert.severity") != "") & ~c("input.alert.severity").isin(vocab.SEVERITIES),
    }
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(when).alias(f"b{i}") for i, when in enumerate(broken.values())]).first()
    for i, rule in enumerate(broken):
        if counts[f"b{i}"]:
            raise InvalidRecords(f"{rule}: {counts[f'b{i}']} records")
    again = rows.groupBy("id").count().filter("count > 1").limit(1).collect()
    if again:
        raise InvalidRecords(f"duplicate id {again[0]['id']}")
    if expected is not None and counts["n"] != expected:
        raise InvalidRecords(f"expected {expected} records, found {counts['n']}")
    return rows


def user_prompt() -> Column:
    """The alert of a parsed record as the question of a chat example; missing fields are N/A."""
    c = F.col
    # The lines of the prompt.
    head = ["Please analyze the following security alert and provide your triage decision in JSON format.", ""]
    alert = [("Title", "title"), ("Severity", "severity"), ("Source", "source"), ("Rule ID", "rule_id"), ("Rule Name", "rule_name"), ("Timestamp", "timestamp")]
    context = [("Hostname", "hostname"), ("Username", "username"), ("Department", "department"), ("OS", "os"), ("Environment", "environment"), ("Asset Criticality", "asset_criticality"), ("IP Address", "ip_address")]
    tail = [
        "", "=== REQUIRED OUTPUT JSON FORMAT ===", "{",
        '  "classification": "benign" | "suspicious" | "likely_malicious" | "confirmed_malicious" | "insufficient_evidence",',
        '  "severity": "informational" | "low" | "medium" | "high" | "critical",', '  "confidence": 0.0 to 1.0,', '  "investigation_required": true | false,',
        '  "summary": "Executive summary of triage decision",', '  "findings": [', '    {"finding": "Description of finding grounded in evidence", "evidence_ids": ["EVT-001"]}',
        "  ],", '  "evidence_ids": ["EVT-001"],', '  "recommended_actions": [',
        '    {"action": "Action description", "priority": "immediate"|"high"|"medium"|"low", "rationale": "Why action is needed"}', "  ]", "}",
    ]
    row = lambda name, at: F.concat(F.lit(f"{name}: "), F.coalesce(at, F.lit("N/A")))
    item = lambda e: F.concat(
        F.lit("["), F.coalesce(e["id"], F.lit("UNKNOWN")), F.lit("] Type: "), F.coalesce(e["type"], F.lit("unknown")), F.lit(" | Time: "), F.coalesce(e["timestamp"], F.lit("")),
        F.lit(" | Description: "), F.coalesce(e["description"], F.lit("")), F.lit(" | Raw: "), F.coalesce(e["raw_data"], F.lit("{}")),
    )
    return F.array_join(F.concat(
        F.array(*[F.lit(x) for x in head], F.lit("=== ALERT DETAILS ==="), *[row(n, c(f"input.alert.{f}")) for n, f in alert], F.lit(""), F.lit("=== HOST & USER CONTEXT ==="), *[row(n, c(f"input.context.{f}")) for n, f in context], F.lit(""), F.lit("=== EVIDENCE ITEMS ===")),
        F.coalesce(F.transform("input.evidence", item), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in tail]),
    ), "\n")


def answer() -> Column:
    """The expected answer of a parsed record as a struct: renamed findings, distinct cited ids in order, highest severity."""
    c = F.col
    cls, conf = c("output.classification"), F.coalesce("output.confidence", F.lit(0.5))
    none = F.array().cast("array<string>")
    findings = F.coalesce(F.transform("output.findings", lambda f: F.struct(F.coalesce(f["description"], F.lit("")).alias("finding"), F.coalesce(f["evidence_refs"], none).alias("evidence_ids"))), F.array().cast("array<struct<finding:string,evidence_ids:array<string>>>"))
    cited = F.array_sort(F.array_distinct(F.flatten(F.transform(findings, lambda f: f["evidence_ids"]))))
    actions = F.coalesce("output.recommended_actions", F.array().cast("array<struct<action:string,priority:string,rationale:string>>"))
    return F.struct(
        cls.alias("classification"), highest_severity("output.findings", F.coalesce("input.alert.severity", F.lit("medium"))).alias("severity"), conf.alias("confidence"),
        (~((cls == "benign") & (conf >= 0.75))).alias("investigation_required"), F.coalesce("output.rationale", F.concat(F.lit("Triage decision: "), cls)).alias("summary"),
        findings.alias("findings"), cited.alias("evidence_ids"), actions.alias("recommended_actions"),
    )


def rejection(a: Column) -> Column:
    """Why the answer struct (a) of a record makes no chat example, the first reason; else null."""
    ids = F.coalesce(F.array_compact(F.transform("input.evidence", lambda e: e["id"])), F.array().cast("array<string>"))
    priority = lambda x: F.coalesce(x["priority"], F.lit("medium"))
    return F.coalesce(
        F.when(F.col("input").isNull(), "missing input"), F.when(F.col("output").isNull(), "missing output"),
        F.when(a["classification"].isNull() | ~a["classification"].isin(vocab.SOC_CLASSIFICATIONS), "invalid classification"),
        F.when(~a["severity"].isin(vocab.SEVERITIES), "invalid severity"), F.when(~a["confidence"].between(0.0, 1.0), "invalid confidence"),
        F.when(F.exists(a["findings"], lambda f: F.exists(f["evidence_ids"], lambda r: ~F.array_contains(ids, r))), "finding cites unknown evidence"),
        F.when(F.exists(a["recommended_actions"], lambda x: x["action"].isNull()), "action without text"),
        F.when(F.exists(a["recommended_actions"], lambda x: ~priority(x).isin(vocab.ACTION_PRIORITIES)), "invalid action priority"),
    )


def to_chat(df: DataFrame, system_prompt: str) -> DataFrame:
    """Parsed records with answer, reason (null for good ones) and messages (null for those with a reason)."""
    out = df.withColumn("answer", answer())
    out = out.withColumn("reason", rejection(F.col("answer")))
    m = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    messages = F.array(m("system", F.lit(system_prompt)), m("user", user_prompt()), m("assistant", F.to_json("answer")))
    return out.withColumn("messages", F.when(F.col("reason").isNull(), messages))


def conversion_counts(chat: DataFrame, split: str) -> DataFrame:
    """(split, source_count, converted_count, rejected_count) of converted records; the test split is never converted."""
    train = chat.filter(F.col(split) != "test")
    return train.groupBy(split).agg(F.count("*").alias("source_count"), F.count("messages").alias("converted_count"), F.count("reason").alias("rejected_count"))


def fingerprints() -> dict[str, Column]:
    """exact: of the whole input as JSON with sorted keys; near: of the title and the first evidence's description."""
    near = F.concat(F.coalesce("input.alert.title", F.lit("")), F.lit("||"), F.coalesce(F.get(F.col("input.evidence"), F.lit(0))["description"], F.lit("")))
    return {"exact": F.sha2(sorted_json(F.to_json("input")), 256), "near": F.sha2(near, 256)}


def duplicate_counts(df: DataFrame) -> DataFrame:
    """(kind, n, n_repeats) of exact and near duplicates of the inputs."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("fp")) for k, v in fingerprints().items()])).alias("x")).select("x.*")
    per = rows.groupBy("kind", "fp").agg(F.count("*").alias("c"))
    return per.groupBy("kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("n_repeats"))


def record_hash(raw: str = "raw") -> Column:
    """Upper-case SHA-256 of a record's JSON with sorted keys and no blanks."""
    return F.upper(F.sha2(sorted_json(F.col(raw)), 256))


def shares(df: DataFrame) -> DataFrame:
    """One row: counts of records with and without Windows as operating system, of borderline records, and of each split."""
    windows = F.coalesce(F.col("input.context.os").contains("Windows"), F.lit(False))
    split = F.col("metadata.split")
    return df.agg(
        F.count("*").alias("n"), F.count_if(windows).alias("n_windows"), F.count_if(~windows).alias("n_linux"), F.count("metadata.borderline_category").alias("n_borderline"),
        *[F.count_if(split == s).alias(f"n_{s}") for s in ("train", "validation", "test")],
    )


def template_checks(df: DataFrame, reference: DataFrame) -> DataFrame:
    """(template_id, technique_id, problem): techniques of templates that the reference does not have, or has otherwise."""
    used = df.select(F.col("metadata.template_id").alias("template_id"), F.explode("output.mitre_techniques").alias("t")).select("template_id", "t.technique_id", "t.technique_name", "t.tactic").distinct()
    known = small(reference.select("technique_id", F.col("technique_name").alias("_n"), F.col("tactic").alias("_t")))
    problem = F.when(F.col("_n").isNull(), "unknown technique").when(~F.col("technique_name").eqNullSafe(F.col("_n")), "other name").when(~F.col("tactic").eqNullSafe(F.col("_t")), "other tactic")
    return used.join(known, "technique_id", "left").select("template_id", "technique_id", problem.alias("problem")).filter("problem is not null")


def top(items: Column, n: int) -> Column:
    """The first n items of an array."""
    return F.slice(items, 1, n)


__all__ = [
    "SCHEMA", "InvalidRecords", "answer", "conversion_counts", "duplicate_counts", "fingerprints", "issues", "load_held_out", "parse", "record_hash", "rejection", "shares", "summary", "template_checks",
    "to_chat", "top", "user_prompt", "validate", "wrong_types",
]
