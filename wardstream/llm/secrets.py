"""Secret scans with an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its content. The ledger remembers which blob was scanned by
which version of which rule, and what was found; a scan reads only the texts of blobs for which a pair of blob and rule
version is missing, each once, however many paths and versions carry it. Findings are joined back to all of them.

A ledger is a folder of two Parquet tables that only grow: ``scans`` (blob, the rule versions applied, what they found) and
``history`` (path, blob). A scan's rows appear together when its job commits, so a run that is lost in between is simply
repeated; the history is written after the scans it rests on. A rule's version is a digest of its definition: a changed rule
is a new one, and only that rule is applied to blobs known before.

Texts are moved once, to bring the copies of a blob together (each task keeps one of its copies first); where few blobs are
unseen, the others' texts are dropped before that. Inside a task a linear matcher tells which texts can hold a finding, and
only these are searched for spans.

Defined cases: a null text is the empty one; repeated rows, and rows with null or equal paths, are versions like others; a
span is counted in code points, its end exclusive; no finding gives an empty array; an empty table gives an empty result;
further columns stay out of the ledger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, scratch_path, spread_join

#: Unseen blobs whose addresses may be broadcast to drop the texts of all others early.
FEW_BLOBS = 250_000
#: Rows that a task searches at a time.
SLICE_ROWS = 1024

SCANS = "blob binary, rules array<string>, found array<struct<kind:string,version:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches, leftmost and without overlap, count if the group has at least ``least`` characters.

    ``hint`` is a pattern for a linear matcher that finds something in every text in which the rule does.
    """

    kind: str
    pattern: str
    hint: str
    least: int = 0
    group: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.pattern}\n{self.least}\n{self.group}".encode()).hexdigest()[:16]

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[^-]*-----END [A-Z0-9 ]*PRIVATE KEY-----"
_JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
_PREFIXED = r"gh[opsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,}|xox[abps]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
_URL = r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"

BASE_RULES = (
    Rule("assign", _ASSIGN, _ASSIGN, 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12}", 16),
    Rule("hex", r"[0-9a-f]{32,}", "[0-9a-f]{32}"),  # of all longest stretches, those that are long enough
)
#: Private keys, signed tokens, tokens with a provider's prefix, and passwords in addresses.
RULES = (*BASE_RULES, Rule("pem", _PEM, _PEM), Rule("jwt", _JWT, _JWT), Rule("prefixed", _PREFIXED, _PREFIXED), Rule("url", _URL, _URL))


def find_secrets(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[dict]:
    """What the rules find in a text, by start and then in the order of the rules."""
    found = []
    for at, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), at, m.end()))
    return [{"kind": rules[at][0].kind, "version": rules[at][0].version, "start": s, "end": e} for s, at, e in sorted(found)]


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``blob``, the SHA-256 of the text's UTF-8 bytes, in place of the text."""
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    return versions.select(*[F.col(f"`{c}`") for c in versions.columns if c not in (text_col, "blob")], F.unhex(F.sha2(text, 256)).alias("blob"))


class Ledger:
    """Blobs scanned so far, by rule version, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}")

    def scans(self) -> DataFrame:
        """blob, rules, found: a row for each blob and scan that read it."""
        kept = self._read("scans")
        return self.spark.createDataFrame([], SCANS) if kept is None else kept

    def unseen(self, versions: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
        """(blob, missing): the blobs of addressed versions that some rule has not read yet, with these rules' places."""
        every = F.array(*[F.lit(i) for i in range(len(rules))])
        blobs = versions.select("blob").distinct()
        kept = self._read("scans")
        if kept is None:
            return blobs.withColumn("missing", every)
        place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
        done = kept.select("blob", F.explode("rules").alias("rule")).select("blob", place[F.col("rule")].alias("i"))
        done = done.filter("i is not null").groupBy("blob").agg(F.collect_set("i").alias("done"))  # no more than there are rules
        missing = F.array_except(every, F.coalesce("done", F.array().cast("array<int>")))
        return blobs.join(done, "blob", "left").select("blob", missing.alias("missing")).filter(F.size("missing") > 0)

    def scan(self, versions: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> None:
        """Reads the texts of unseen blobs, each once, by the rules that have not read them, and adds what they find."""
        names = [r.kind for r in rules]
        if len(set(names)) < len(names):
            raise ValueError("two rules bear one kind")
        rows = versions.select(F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8").alias("text"))
        rows = rows.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
        if self._read("scans") is None:
            wanted = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("missing", F.array(*[F.lit(i) for i in range(len(rules))]))
        else:
            unseen, _ = materialise(self.unseen(rows, rules), "secrets-unseen")
            n = unseen.count()
            if not n:
                return
            if n <= FEW_BLOBS:
                rows = rows.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")
            wanted = rows.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")
        _searched(wanted, rules).write.mode("append").option("compression", "zstd").parquet(f"{self.root}/scans")

    def record(self, versions: DataFrame, path_cols: Sequence[str], text_col: str = "text") -> None:
        """Adds the paths' versions to the history, each pair of path and blob once."""
        path = F.struct(*[F.col(f"`{c}`") for c in path_cols]).alias("path")
        new = addressed(versions.select(path, F.col(f"`{text_col}`").alias("text"))).distinct()
        kept = self._read("history")
        if kept is not None:
            new = new.alias("n").join(kept.alias("k"), F.expr("n.path <=> k.path and n.blob = k.blob"), "left_anti")
        new.write.mode("append").option("compression", "zstd").parquet(f"{self.root}/history")

    def add(self, versions: DataFrame, path_cols: Sequence[str], text_col: str = "text", rules: Sequence[Rule] = RULES) -> None:
        """Scans what is unseen among the versions, then records them."""
        self.scan(versions, text_col, rules)
        self.record(versions, path_cols, text_col)

    def found(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """(blob, found) of the blobs in which these rule versions found something, by start and order of the rules."""
        order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
        hits = self.scans().filter(F.size("found") > 0).select("blob", F.explode("found").alias("f"))
        hits = hits.withColumn("i", order[F.concat("f.kind", F.lit(":"), "f.version")]).filter("i is not null")
        key = F.struct(F.col("f.start").alias("start"), "i", F.col("f.end").alias("end"), F.col("f.kind").alias("kind"))
        spans = F.transform(F.array_sort(F.collect_set(key)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return hits.groupBy("blob").agg(spans.alias("found"))  # the findings of one text

    def join_findings(self, rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
        """Addressed rows with what the rules found in their blobs; a frequent blob's rows meet in no task."""
        found, _ = materialise(self.found(rules), "secrets-found")
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
        return spread_join(rows, found, "blob", found.count(), "left").withColumn("found", F.coalesce("found", none))

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """path, blob, found of every version in the history."""
        kept = self._read("history")
        if kept is None:
            raise ValueError("nothing was recorded yet")
        return self.join_findings(kept, rules).select("path", "blob", "found")


def _searched(wanted: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Scan rows of texts (blob, text, missing), each searched by the rules it misses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern)) for r in rules]
        span = pa.struct([("kind", pa.string()), ("version", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            for lo in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(lo, SLICE_ROWS)
                hints = [pc.match_substring_regex(part.column(1), r.hint).to_pylist() for r in rules]
                missing, found = part.column(2).to_pylist(), []
                for i, places in enumerate(missing):
                    due = [compiled[k] for k in places if hints[k][i]]
                    found.append(find_secrets(part.column(1)[i].as_py().decode("utf-8", "replace"), due) if due else [])
                applied = [[rules[k].name for k in places] for places in missing]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(applied, pa.list_(pa.string())), pa.array(found, pa.list_(span))], ["blob", "rules", "found"])

    return wanted.select("blob", "text", "missing").mapInArrow(run, SCANS)


def spans_text(found: str) -> str:
    """SQL for the spans of an array column, comma-joined."""
    return f"array_join(transform({found}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Scans all documents into a fresh ledger and joins what was found back to every one of them."""
    spark = docs.sparkSession
    ledger = Ledger(spark, scratch_path(spark, "secrets-ledger"))
    ledger.scan(docs)
    rows = ledger.join_findings(addressed(docs.select("doc_id", "text")))
    base = "filter(found, x -> x.kind in ('assign', 'access', 'hex'))"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.expr(f"sha2({spans_text(base)}, 256) as base_sha256"), F.expr(f"{spans_text('found')} as spans"))


def _sql_spans(at: int, rule: Rule) -> str:
    """DuckDB SQL: a list of the rule's spans, from the pieces of text between its matches."""
    quoted = rule.pattern.replace("'", "''") if rule.kind != "access" else "AKIA[A-Z0-9]{12,}"
    pieces, hits = f"string_split_regex(t, '{quoted}')", f"regexp_extract_all(t, '{quoted}')"
    size = f"list_transform(regexp_extract_all(t, '{quoted}', {rule.group}), lambda x: length(x))"
    begin = "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    listed = f"list_transform(range(1, len(hits) + 1), lambda i: {{'s': ({begin})::BIGINT, 'k': {at}, 'kind': '{rule.kind}', 'n': length(hits[i]), 'm': sizes[i]}})"
    return (
        f"SELECT doc_id, id, list_filter({listed}, lambda x: x.m >= {rule.least}) AS found FROM (SELECT doc_id, id, {pieces} AS pieces, {hits} AS hits, {size} AS sizes FROM d)"
    )


#: Groups of capitals and small letters are spelt out, so that both matchers read the patterns alike.
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t FROM documents),
each AS ({' UNION ALL '.join(_sql_spans(i, r) for i, r in enumerate(RULES))}),
spans AS (SELECT id, any_value(doc_id) AS doc_id, list_sort(flatten(list(found))) AS f FROM each GROUP BY id)
SELECT doc_id, len(list_filter(f, lambda x: x.kind = 'assign')) AS n_assign, len(list_filter(f, lambda x: x.kind = 'access')) AS n_access,
    len(list_filter(f, lambda x: x.kind = 'hex')) AS n_hex,
    sha256(array_to_string(list_transform(list_filter(f, lambda x: x.k < 3), lambda x: x.kind || ':' || x.s || ':' || (x.s + x.n)), ',')) AS base_sha256,
    array_to_string(list_transform(f, lambda x: x.kind || ':' || x.s || ':' || (x.s + x.n)), ',') AS spans
FROM spans
"""
