"""Language identification by prediction by partial matching.

One variable-order byte context tree per language, frozen after training. A byte costs -log2 of its share in the
longest context seen in training (order 3 at most); a context that never saw the byte first pays its escape, at
probability q / (total + q) with q distinct followers, then the next shorter context is asked; the last resort is 8
bits. No exclusions are made, so each code length is a sum of table entries and exact. A document's language is that
of the shortest code; ``score`` is its posterior under equal priors.

Text is lower-cased and every run of ASCII non-letters becomes one space before coding; whole texts are coded.

Defined cases: null text, or text without a letter, is ``und`` with score 0; equal texts get equal results; a tie goes
to the language first in order; any number of languages can be learned; rows with null lang teach nothing; a language whose labelled texts are all empty or
without letters is not learned, one with a single long text is; with nothing to learn from all rows are ``und``; an
empty table gives an empty result; columns other than id, text and lang are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import by_place, map_arrow, materialise, small_or_plain

ORDER = 3
#: Bound of the training sample: documents and UTF-8 bytes for each language. Documents are taken whole in the order of
#: a hash; the one that crosses the bound is the last, of which as many bytes as the bound has left are learned.
SAMPLE_DOCS = 600
SAMPLE_BYTES = 1_500_000
#: Languages whose trees are one table; documents are coded by group after group, and the best code so far is kept.
GROUP_LANGUAGES = 16
#: Table entries (strings times languages) that a worker keeps from one batch of documents to the next.
ENTRIES_HELD = 20_000_000
#: Bytes coded at once, which bounds a worker's memory.
CHUNK = 1 << 19
UNKNOWN = "und"

_TO_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
_PAD = b" " * ORDER


def normalize(text: str | None) -> bytes:
    """Lower-cased UTF-8 with every run of ASCII non-letters as one space."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_TO_LETTERS).split())


def has_letter(text: str | None, plain: bytes) -> bool:
    if plain.isascii():
        return bool(plain)
    return any(b < 0x80 and b != 32 for b in plain) or any(c.isalpha() for c in text or "")


def grams(data: np.ndarray) -> np.ndarray:
    """For each byte after the first ORDER, itself and the ORDER bytes before it as one 32-bit number."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


class Model:
    """Code lengths of all languages, from counts of 4-byte strings."""

    SLOTS = 20

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.languages = languages
        n_lang = len(languages)
        self.keys, self.cost, self.escape = [], [], []
        below = np.full((256, n_lang), 8.0, np.float64)  # order -1
        for order in range(ORDER + 1):
            part = gram & np.uint32((1 << 8 * (order + 1)) - 1)
            keys, at = np.unique(part, return_inverse=True)
            n = np.zeros((len(keys), n_lang))
            np.add.at(n, (at, lang), count)
            contexts, ctx = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
            np.add.at(total, ctx, n)
            np.add.at(kinds, ctx, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[ctx])
            shorter = below[keys & 0xFF] if order == 0 else self._at(order - 1, keys & np.uint32((1 << 8 * order) - 1))
            self.keys.append((keys, contexts))
            self.cost.append(np.where(n > 0, seen, escape[ctx] + shorter))
            self.escape.append(escape)
        self.uniform = below
        # Frequent strings sit in a direct table; others are found by search.
        top, weight = self.keys[ORDER][0], np.zeros(len(self.keys[ORDER][0]))
        np.add.at(weight, np.searchsorted(top, gram), count)
        order = np.argsort(weight, kind="stable")
        self.slot_row = np.zeros(1 << self.SLOTS, np.int32)
        self.slot_row[self._slot(top[order])] = order
        self.top_cost = self.cost[ORDER].astype(np.float32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint32(2654435761)) >> np.uint32(32 - self.SLOTS)

    def _at(self, order: int, g: np.ndarray) -> np.ndarray:
        """Costs (rows of g, languages) of strings of order + 1 bytes."""
        keys, contexts = self.keys[order]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[at] == g
        out = self.cost[order][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            m = g[miss]
            c = np.minimum(np.searchsorted(contexts, m >> 8), len(contexts) - 1)
            known = contexts[c] == m >> 8
            rest = self.uniform[m & 0xFF] if order == 0 else self._at(order - 1, m & np.uint32((1 << 8 * order) - 1))
            out[miss] = rest + np.where(known[:, None], self.escape[order][c], 0.0)
        return out

    def costs(self, g: np.ndarray) -> np.ndarray:
        row = self.slot_row[self._slot(g)]
        out = self.top_cost[row]
        miss = np.flatnonzero(self.keys[ORDER][0][row] != g)
        if len(miss):
            out[miss] = self._at(ORDER, g[miss])
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each normalized text (rows) in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        group, size = [], 0
        for i, x in enumerate(texts):
            for at in range(0, len(x), CHUNK):
                piece = (_PAD if at == 0 else x[at - ORDER : at]) + x[at : at + CHUNK]
                group.append((i, piece))
                size += len(piece)
                if size >= CHUNK:
                    self._add(out, group)
                    group, size = [], 0
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, bytes]]) -> None:
        sizes = np.array([len(p) for _, p in group])
        g = grams(np.frombuffer(b"".join(p for _, p in group), np.uint8))
        starts = np.cumsum(sizes) - sizes
        drop = np.zeros(len(g) + ORDER, bool)
        for k in range(1, ORDER + 1):
            drop[starts[1:] - k] = True  # strings across two texts
        c = self.costs(g[~drop[: len(g)]])
        begin = np.cumsum(sizes - ORDER) - (sizes - ORDER)
        np.add.at(out, [i for i, _ in group], np.add.reduceat(c, begin, axis=0, dtype=np.float64))


_MODELS: dict[str, Model] = {}


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that teach nothing: CRC-32 of the id as text is 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, bytes_each: int = SAMPLE_BYTES) -> DataFrame:
    """(text, lang, room): documents with the lowest hashes of id and text, within the bounds for each language.

    Of the last document of a language only ``room`` bytes are learned. A language of one document has a sample.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").cast("long").alias("b"))
    per, _ = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "of"), "language-sizes")
    # A hash threshold first leaves about twice the sample, so that no language meets whole in one task.
    unit = F.col("h").cast("double") / 2.0**64 + 0.5
    sized = rows.join(small_or_plain(per, per.count()), F.col("lang") == F.col("of"))
    few = sized.filter(unit < F.lit(2 * docs_each + 50) / F.col("n")).select("text", "lang", "h", "b")
    order = Window.partitionBy("lang").orderBy("h", "text")
    few = few.withColumn("k", F.row_number().over(order)).withColumn("upto", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    few = few.withColumn("room", F.least("b", F.lit(bytes_each) - F.col("upto") + F.col("b")))
    return few.filter((F.col("k") <= docs_each) & ((F.col("room") > 0) | (F.col("b") == 0))).select("text", "lang", "room")


def train(docs: DataFrame, docs_each: int = SAMPLE_DOCS, bytes_each: int = SAMPLE_BYTES, group_languages: int = GROUP_LANGUAGES) -> list[Broadcast]:
    """Counts of 4-byte strings by language, over the bounded sample: one broadcast table for each group of languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for text, lang, room in zip(*(c.to_pylist() for c in b.columns)):
                texts.setdefault(lang, []).append(normalize(text.encode("utf-8", "replace")[:room].decode("utf-8", "ignore")))
            for lang, part in texts.items():
                keys, n = np.unique(np.concatenate([grams(np.frombuffer(_PAD + t, np.uint8)) for t in part]), return_counts=True)
                made = [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(made, ["lang", "gram", "n"])

    counted = training_sample(docs, docs_each, bytes_each).mapInArrow(count, "lang string, gram bigint, n bigint")
    counted, _ = materialise(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-strings")
    languages = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]  # names alone
    sent = []
    for first in range(0, len(languages), group_languages):
        some = languages[first : first + group_languages]
        rows = counted.filter(F.col("lang").isin(some)).toPandas().sort_values(["gram", "lang"])  # at most bytes_each rows a language of the group
        code = {x: i for i, x in enumerate(some)}
        packed = {"id": uuid.uuid4().hex, "languages": some, "lang": rows["lang"].map(code).to_numpy(np.int64), "gram": rows["gram"].to_numpy(np.uint32), "n": rows["n"].to_numpy(np.float64)}
        sent.append(docs.sparkSession.sparkContext.broadcast(packed))
    return sent


def load(packed: dict) -> Model:
    """The group's model; those used longest ago go when the entries held are too many."""
    model = _MODELS.pop(packed["id"], None) or Model(packed["languages"], packed["lang"], packed["gram"], packed["n"])
    _MODELS[packed["id"]] = model
    while len(_MODELS) > 1 and sum(m.top_cost.size for m in _MODELS.values()) > ENTRIES_HELD:
        _MODELS.pop(next(iter(_MODELS)))
    return model


def judge(texts: list[str | None], groups: list[dict]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits a byte of each text."""
    plain = [normalize(t) for t in texts]
    at = [i for i, (t, p) in enumerate(zip(texts, plain)) if groups and has_letter(t, p)]
    names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [8.0] * len(texts)
    if not at:
        return names, scores, rates
    least, share, found = np.full(len(at), np.inf), np.zeros(len(at)), np.full(len(at), None, object)
    coded = [plain[i] for i in at]
    for packed in groups:
        model = load(packed)
        bits = model.lengths(coded)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(at)), best]
        better = low < least  # a tie stays with the language first in order
        now = np.where(better, low, least)
        share = share * np.exp2(np.maximum(now - np.where(np.isinf(least), now, least), -1000)) + np.exp2(np.maximum(now[:, None] - bits, -1000)).sum(axis=1)
        found[better] = np.array(model.languages, object)[best[better]]
        least = now
    for j, i in enumerate(at):
        names[i], scores[i], rates[i] = found[j], float(1.0 / share[j]), float(least[j] / len(plain[i]))
    return names, scores, rates


def predict(docs: DataFrame, groups: list[Broadcast], made: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte"), text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (of the best language); input columns of these names give way."""
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in made])
    at = [c.lower() for c in rows.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rates = judge(b.column(at).to_pylist(), [g.value for g in groups])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*b.schema.names, *made])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(m, k) for m, k in zip(made, (T.StringType(), T.DoubleType(), T.DoubleType()))]])
    return map_arrow(rows, run, schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, the model learned from the documents not held out."""
    groups = train(docs)
    return predict(docs.select("doc_id", "text"), groups).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, max_bits: float = 8.0) -> DataFrame:
    """The documents in some learned language: not ``und``, and coded in fewer bits a byte than no model at all."""
    plain, at = by_place(docs)
    out = predict(plain, train(docs), text_col=at["text"])
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < max_bits)).select(*plain.columns).toDF(*docs.columns)
