"""Chunking, BM25 retrieval, indicator extraction and lookup, injection scan, telemetry filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import rounded, search_tokens, strip
from ..session import small, written


def chunk(df: DataFrame, key: str, text: str, size: int = 400, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, chunk_id, content): windows of ``size`` characters every size - overlap; blank ones take no index."""
    if size < 50 or not 0 <= overlap < size:
        raise ValueError("size must be at least 50 and overlap below it")
    step, n = size - overlap, F.length("_t")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < n)))
    parts = F.filter(F.transform(starts, lambda s: strip(F.substring(F.col("_t"), s + 1, F.lit(size)))), lambda x: x != "")
    rows = df.select(F.col(key), strip(F.col(text)).alias("_t")).select(key, F.posexplode(parts).alias("chunk_index", "content"))
    return rows.withColumn("chunk_id", F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_index").cast("string")))


def bm25_index(df: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """postings (key, term, tf, len), terms (term, df, idf) and stats (n, avg_len)."""
    tokens = df.select(key, search_tokens(F.col(text)).alias("tok")).withColumn("len", F.size("tok"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = tokens.select(key, "len", F.explode("tok").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    idf = F.greatest(F.lit(0.01), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"))
    return {"postings": postings, "terms": terms, "stats": stats}


def bm25(df: DataFrame, key: str, text: str, queries: DataFrame, k: int = 3, threshold: float = 0.05, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank): top k above the threshold, ties by key.

    Only terms that some query asks for are grouped and counted. A query of four characters or more that is a substring
    of a text's distinct terms (joined by blanks, in order) adds 2. Of a query of three words or more an inner word is
    then a whole term of the text, so it is looked for among the hits of that term only.
    """
    tokens = written(df.select(key, search_tokens(F.coalesce(text, F.lit(""))).alias("tok")), "tokens")  # a null text has length 0
    stats = F.broadcast(written(tokens.agg(F.count("*").alias("n"), F.avg(F.size("tok")).alias("avg_len")), "stats"))  # one row
    asked = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    terms = small(asked.select("term").distinct())
    postings = tokens.select(key, F.size("tok").alias("len"), F.explode("tok").alias("term")).join(terms, "term", "left_semi")
    postings = written(postings.groupBy(key, "len", "term").agg(F.count("*").alias("tf")), "postings")
    idf = F.greatest(F.lit(0.01), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats).select("term", idf.alias("idf"), "avg_len")
    weights = written(asked.join(weights, "term").select("query_id", "term", "qn", "idf", "avg_len"), "weights")
    want = queries.select("query_id", F.lower(strip(F.col("query"))).alias("_q")).filter(F.length("_q") >= 4)
    inner = F.slice(F.split("_q", " "), 2, F.greatest(F.size(F.split("_q", " ")) - 2, F.lit(0)))
    want = want.withColumn("term", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    words = tokens.select(key, F.array_join(F.array_distinct("tok"), " ").alias("_w"))
    long = written(postings.select(key, "term").join(small(want.filter("term is not null")), "term").select("query_id", key, "_q"), "bonus")
    bonus = words.join(small(long), key).filter(F.col("_w").contains(F.col("_q"))).select("query_id", key)
    short = want.filter("term is null").select("query_id", "_q")
    if short.limit(1).count():  # else no text is looked at
        bonus = bonus.union(words.join(small(short), F.col("_w").contains(F.col("_q"))).select("query_id", key))
    # Postings and bonuses go to their text's task before they are multiplied by the queries: a hit is never shuffled.
    rows = postings.unionByName(bonus.select(F.col("query_id").alias("_for"), key, F.lit(2.0).alias("_bonus")), allowMissingColumns=True).repartition(key)
    tf, norm = F.col("tf"), k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    part = F.col("qn") * F.col("idf") * tf * (k1 + 1) / (tf + norm)
    hits = rows.join(small(weights), "term", "left").select(F.when(F.col("_bonus").isNull(), F.col("query_id")).otherwise(F.col("_for")).alias("query_id"), key, F.coalesce("_bonus", part).alias("part"))
    scored = hits.groupBy("query_id", key).agg(rounded(F.sum("part")).alias("score")).filter(F.col("score") > threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def indicators(df: DataFrame, key: str, text: str, lead: str = "text") -> DataFrame:
    """(key, indicator, type, source): addresses, SHA-256 hashes and technique ids, the first of each (any case) in a row."""
    found = lambda pattern, kind: F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("indicator"), F.lit(kind).alias("type")))
    every = F.concat(F.filter(found(vocab.IPV4, "ip"), lambda x: ~x["indicator"].isin("0.0.0.0", "255.255.255.255")), found(vocab.SHA256, "hash"), found(vocab.TECHNIQUE, "technique"))
    long = F.filter(every, lambda x: F.length(x["indicator"]) > 3)
    first = F.filter(F.transform(long, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~F.exists(F.slice(long, 1, y["i"]), lambda z: F.lower(z["indicator"]) == F.lower(y["x"]["indicator"])))
    return df.select(key, F.posexplode(first).alias("seq", "y")).select(key, "seq", F.col("y.x.indicator").alias("indicator"), F.col("y.x.type").alias("type"), F.lit(lead).alias("source"))


def injections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern_no) for each prompt-injection pattern that the text matches."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(vocab.INJECTIONS)]), lambda x: x.isNotNull())
    return df.select(key, F.explode(hits).alias("pattern_no"))


def intel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.INDICATORS, "indicator string, indicator_type string, reputation string, confidence double, threat_actor string, malware_family string")


def intel_lookup(df: DataFrame, indicator: str, kind: str | None = None) -> DataFrame:
    """The rows with what is known of their indicator (trimmed, any case), and an evidence id. The table has 13 rows."""
    t = intel_table(df.sparkSession)
    t = t.filter(F.col("indicator_type") == kind) if kind else t
    t = F.broadcast(t.withColumnRenamed("indicator", "_i"))
    out = df.join(t, F.lower(strip(F.col(indicator))) == F.lower("_i"), "left")
    evidence = F.concat(F.lit("TI-"), F.substring(F.regexp_replace(F.col(indicator), "[^A-Za-z0-9]", "_"), 1, 32))
    return out.withColumn("found", F.col("_i").isNotNull()).withColumn("evidence_id", evidence).drop("_i")


def intel_search(spark: SparkSession, query: str) -> DataFrame:
    t = intel_table(spark)
    return t.filter(F.lower(F.concat_ws(" ", "indicator", "threat_actor", "malware_family")).contains(query.strip().lower()))


def _matches(asked: DataFrame, keyword: str, known: DataFrame, fields: list[str]) -> DataFrame:
    """asked with the rows of a table of fixed size whose fields hold the keyword (trimmed, any case); a blank one finds none."""
    key = F.lower(strip(F.col(keyword)))
    words = asked.select(key.alias("_key")).distinct().filter("_key <> ''")
    held = F.broadcast(known.withColumn("_in", F.lower(F.concat_ws(" ", *fields))))  # a few dozen rows
    found = words.join(held, F.col("_in").contains(F.col("_key"))).drop("_in")
    return asked.withColumn("_ask", key).join(small(found), F.col("_ask") == F.col("_key")).drop("_ask", "_key")


def intel_matches(asked: DataFrame, keyword: str) -> DataFrame:
    """Each row with the indicators that have its keyword in their name, actor or malware family."""
    return _matches(asked, keyword, intel_table(asked.sparkSession), ["indicator", "threat_actor", "malware_family"])


def technique_matches(asked: DataFrame, keyword: str) -> DataFrame:
    """Each row with the techniques that have its keyword in their id, name or tactic."""
    return _matches(asked, keyword, techniques(asked.sparkSession), ["technique_id", "technique_name", "tactic"])


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.TECHNIQUES, "technique_id string, technique_name string, tactic string")


def technique_search(spark: SparkSession, query: str) -> DataFrame:
    q = query.strip().lower()
    return techniques(spark).filter(F.lower(F.concat_ws(" ", "technique_id", "technique_name", "tactic")).contains(q))


def ground(df: DataFrame, refs: str, valid: str, reject: bool = False) -> DataFrame:
    """Keeps the valid references (strip) or the rows whose references are all valid (reject); lists the invalid ones."""
    out = df.withColumn("invalid_refs", F.array_except(refs, valid)).withColumn("kept_refs", F.filter(refs, lambda r: F.array_contains(valid, r)))
    return out.filter(F.size("invalid_refs") == 0) if reject else out


def telemetry(df: DataFrame, contains: dict[str, str] | None = None, equals: dict[str, object] | None = None, within: dict[str, str] | None = None) -> DataFrame:
    """Rows whose fields contain a text in any case, equal a value, or contain a text as written."""
    for f, v in (contains or {}).items():
        df = df.filter(F.lower(f).contains(v.lower()))
    for f, v in (equals or {}).items():
        df = df.filter(F.col(f) == v)
    for f, v in (within or {}).items():
        df = df.filter(F.col(f).contains(v))
    return df


def response_json(text: Column) -> Column:
    """The JSON object in a model's answer (fences and talk around it dropped), if it parses."""
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def decision(body: Column) -> Column:
    """Triage decision with defaults: class, severity, confidence in 0..1 (0.5 if none), investigation_required."""
    get = lambda k: F.lower(F.get_json_object(body, f"$.{k}"))
    cls = F.when(get("classification").isin(vocab.SOC_CLASSIFICATIONS), get("classification")).otherwise("insufficient_evidence")
    sev = F.when(get("severity").isin(vocab.SEVERITIES), get("severity")).otherwise("medium")
    conf = F.least(F.greatest(F.coalesce(get("confidence").try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    need = F.coalesce(get("investigation_required").try_cast("boolean"), cls != "benign")
    return F.struct(cls.alias("classification"), sev.alias("severity"), conf.alias("confidence"), need.alias("investigation_required"))
