"""The reference library that analysts search: documents of techniques and indicators, indexed and asked by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small, written
from .inverted import Index
from .retrieval import bm25, chunk, intel_lookup, intel_table, techniques


def _or(df: DataFrame, name: str, other: str) -> Column:
    return F.coalesce(F.col(name), F.lit(other)) if name in df.columns else F.lit(other)


def _listed(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.array_join(name, ", "), F.lit("")) if name in df.columns else F.lit("")


def technique_documents(df: DataFrame) -> DataFrame:
    """(doc_id, title, content, source_type) of rows (technique_id, technique_name, tactic, and description if there is one)."""
    tid, name = _or(df, "technique_id", "T0000"), _or(df, "technique_name", "Unknown")
    content = F.concat(F.lit("MITRE ATT&CK Technique: "), tid, F.lit(" - "), name, F.lit("\nTactic: "), _or(df, "tactic", "Unknown"), F.lit("\nDescription: "), _or(df, "description", ""))
    return df.select(F.concat(F.lit("MITRE-"), tid).alias("doc_id"), F.concat(F.lit("MITRE "), tid, F.lit(": "), name).alias("title"), content.alias("content"), F.lit("mitre_technique").alias("source_type"))


def indicator_documents(df: DataFrame) -> DataFrame:
    """The same of rows (indicator, indicator_type, reputation, threat_actor, malware_family; mitre_techniques and tags are
    arrays, and like description optional)."""
    ind, malware = _or(df, "indicator", "UNKNOWN"), _or(df, "malware_family", "None")
    content = F.concat(
        F.lit("Threat Intelligence Indicator: "), ind, F.lit(" ("), F.upper(_or(df, "indicator_type", "unknown")), F.lit(")\nReputation: "), F.upper(_or(df, "reputation", "unknown")),
        F.lit(" | Threat Actor: "), _or(df, "threat_actor", "Unknown"), F.lit(" | Malware: "), malware, F.lit("\nMITRE Techniques: "), F.coalesce(F.nullif(_listed(df, "mitre_techniques"), F.lit("")), F.lit("None")),
        F.lit("\nTags: "), _listed(df, "tags"), F.lit("\nDescription: "), _or(df, "description", ""),
    )
    return df.select(F.concat(F.lit("TI-"), F.translate(ind, ":/", "__")).alias("doc_id"), F.concat(F.lit("Threat Intel: "), ind, F.lit(" ("), malware, F.lit(")")).alias("title"), content.alias("content"), F.lit("threat_intel_report").alias("source_type"))


class Library:
    """Chunks of documents (doc_id, title, content), searched by title and content.

    In memory a library is its table of chunks, scored as a whole by ``scorer`` (``bm25`` or a function with its arguments
    and columns). ``save`` writes the chunks and a kept index beside them; a library that was loaded asks that index and
    reads only the postings and the chunks that it needs, and ``add`` puts further documents into both.
    """

    def __init__(self, chunks: DataFrame, top_k: int = 3, threshold: float = 0.05, scorer=bm25, index: Index | None = None, path: str | None = None):
        self.chunks, self.top_k, self.threshold, self.scorer, self.index, self.path = chunks, top_k, threshold, scorer, index, path

    @staticmethod
    def cut(documents: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
        """The chunks of documents, with the text that is searched."""
        titled = documents.select("doc_id", "title")
        parts = chunk(documents.select("doc_id", "content"), "doc_id", "content", size, overlap)
        return parts.join(titled, "doc_id").select("chunk_id", "doc_id", "title", "content", F.concat("title", F.lit("\n"), "content").alias("text"))

    @classmethod
    def build(cls, documents: DataFrame, size: int = 400, overlap: int = 50, **settings) -> Library:
        return cls(cls.cut(documents, size, overlap), **settings)

    @classmethod
    def default(cls, spark, **settings) -> Library:
        return cls.build(technique_documents(techniques(spark)).union(indicator_documents(intel_table(spark))), **settings)

    @classmethod
    def load(cls, spark, path: str, **settings) -> Library:
        return cls(spark.read.parquet(f"{path}/chunks"), index=Index(spark, f"{path}/index"), path=path, **settings)

    def save(self, path: str) -> None:
        self.chunks.write.mode("errorifexists").parquet(f"{path}/chunks")
        Index(self.chunks.sparkSession, f"{path}/index").add(self.chunks.sparkSession.read.parquet(f"{path}/chunks"), "chunk_id", "text")

    def add(self, documents: DataFrame, size: int = 400, overlap: int = 50) -> Library:
        """The library with further documents; of a saved one, chunks whose ids it holds already stay as they are."""
        new = self.cut(documents, size, overlap)
        if self.index is None:
            return Library(self.chunks.unionByName(new), self.top_k, self.threshold, self.scorer)
        new = written(new.join(self.chunks.select("chunk_id"), "chunk_id", "left_anti"), "library-new")
        new.select(*self.chunks.columns).write.mode("append").parquet(f"{self.path}/chunks")
        self.index.add(new, "chunk_id", "text")
        return Library.load(self.chunks.sparkSession, self.path, top_k=self.top_k, threshold=self.threshold)

    def count(self) -> int:
        return self.chunks.count() if self.index is None else self.index.count()

    def search(self, queries: DataFrame, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, title, content, score) for rows (query_id, query); blank queries find nothing."""
        k, least = top_k or self.top_k, self.threshold if threshold is None else threshold
        if self.index is not None:
            found = self.index.search(queries, k, least).withColumnRenamed("key", "chunk_id")
        else:
            found = self.scorer(self.chunks, "chunk_id", "text", queries, k, least)
        return small(written(found, "library-found")).join(self.chunks.select("chunk_id", "title", "content"), "chunk_id")

    def indicator_report(self, asked: DataFrame, top_k: int = 2) -> DataFrame:
        """Each row (query_id, query) with has_threat_intel, reputation (unknown if there is none) and its best chunk ids."""
        direct = intel_lookup(asked, "query").select("query_id", "query", F.col("found").alias("has_threat_intel"), F.coalesce("reputation", F.lit("unknown")).alias("reputation"))
        best = self.search(asked, top_k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
        return direct.join(best, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def context_text(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, context): what was found for each asked row as one text for a prompt, best first."""
    block = F.concat(F.lit("\n[Source: "), "title", F.lit(" | Relevance Score: "), F.format_string("%.2f", "score"), F.lit("]\n"), "content")
    texts = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))).alias("b"))
    # The lines around the blocks.
    body = F.concat(F.lit("=== RETRIEVED THREAT INTELLIGENCE & MITRE KNOWLEDGE ===\n"), F.array_join(F.transform("b", lambda x: x["t"]), "\n"), F.lit("\n\n======================================================="))
    none = F.lit("No relevant threat intelligence or MITRE context found.")
    return asked.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce(body, none).alias("context"))


__all__ = ["Library", "context_text", "indicator_documents", "technique_documents"]
