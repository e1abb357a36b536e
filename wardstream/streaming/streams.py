"""The stateless record transforms on streams, and three kinds of stateful deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import vocab
from ..operators import records

#: Keeps state entry by entry, changed ones alone written at a checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def evaluated(stream: DataFrame) -> DataFrame:
    """``records.evaluated`` for streams, which take no row ids: all rows pass a filter on a random number."""
    return stream.withColumn("_once", F.rand()).filter("_once >= 0").drop("_once")


def prepare(stream: DataFrame) -> DataFrame:
    """Normalized, validated, fingerprinted: the same expressions as in batch, so they run on a stream as they are."""
    out = records.as_records(stream).transform(records.normalize).transform(evaluated).transform(records.validate)
    return out.withColumn("fingerprint", records.fingerprint(vocab.EXACT_FIELDS)).transform(evaluated)


def unique(stream: DataFrame) -> DataFrame:
    """First of each fingerprint; the state keeps every fingerprint."""
    return prepare(stream).filter("status <> 'rejected'").dropDuplicates(["fingerprint"])


def outcomes(stream: DataFrame) -> DataFrame:
    """Every row of the stream with its outcome: record_id, fingerprint, status and duplicate_of; nothing is dropped.

    The first row of a fingerprint that comes is kept in the state. Rejected rows need none and go past it: as groups of
    one row each they would cost a call of the function for every row.
    """
    rows = prepare(stream).select("record_id", "record_index", "fingerprint", "status")
    bad = F.col("status").eqNullSafe("rejected")

    def run(key, batches, state):
        import pandas as pd

        first, fresh = (state.get[0], False) if state.exists else (None, True)
        for rows in batches:
            out = []
            for rid, fp, status in rows.sort_values(["record_index", "record_id"])[["record_id", "fingerprint", "status"]].itertuples(index=False):
                out.append((rid, fp, "duplicate" if first is not None else status, first))
                first = rid if first is None else first
            if fresh and first is not None:
                state.update((first,))
                fresh = False
            yield pd.DataFrame(out, columns=["record_id", "fingerprint", "status", "duplicate_of"])

    made = "record_id string, fingerprint string, status string, duplicate_of string"
    live = rows.filter(~bad).groupBy("fingerprint").applyInPandasWithState(run, made, "first string", "append", GroupStateTimeout.NoTimeout)
    return live.unionByName(rows.filter(bad).select("record_id", "fingerprint", "status", F.lit(None).cast("string").alias("duplicate_of")))


def unique_within(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """First of each fingerprint within the watermark's delay: bounded state."""
    return prepare(stream).filter("status <> 'rejected'").withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


class FifoProcessor(StatefulProcessor):
    """Fingerprints of one shard, the oldest forgotten beyond ``limit``.

    Two maps and three counters are kept: fingerprint to its first row and number, number to fingerprint, and the numbers
    of the oldest and the next one. A fingerprint is read once for each Arrow batch it is in, a new one writes two entries,
    an eviction removes two: the cost of a batch follows its rows and not what is remembered.
    """

    MADE = "record_id string, fingerprint string, duplicate_of string, evictions bigint"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getMapState("firsts", "fingerprint string", "record_id string, number bigint")
        self.order = handle.getMapState("order", "number bigint", "fingerprint string")
        self.counters = handle.getValueState("counters", "oldest bigint, following bigint, evictions bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        oldest, following, gone = self.counters.get() or (0, 0, 0)
        for batch in rows:
            out, known = [], {}  # known: what the state holds of this batch's fingerprints, as each look there is a call to the JVM
            for rid, fp in batch.sort_values(["record_index", "record_id"])[["record_id", "fingerprint"]].itertuples(index=False):
                held = known[fp] if fp in known else self.firsts.getValue((fp,))
                known[fp] = (rid, following) if held is None else held
                if held is None:
                    self.firsts.updateValue((fp,), (rid, following))
                    self.order.updateValue((following,), (fp,))
                    following += 1
                    if following - oldest > self.limit:
                        last = tuple(self.order.getValue((oldest,)))
                        self.firsts.removeKey(last)
                        self.order.removeKey((oldest,))
                        known.pop(last[0], None)
                        oldest, gone = oldest + 1, gone + 1
                out.append((rid, fp, None if held is None else held[0], gone))
            yield pd.DataFrame(out, columns=["record_id", "fingerprint", "duplicate_of", "evictions"])
        self.counters.update((oldest, following, gone))

    def close(self) -> None:
        pass


class RecentProcessor(StatefulProcessor):
    """The first row of each fingerprint of a shard, forgotten ``seconds`` after it came."""

    MADE = "record_id string, fingerprint string, duplicate_of string"

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getMapState("firsts", "fingerprint string", "record_id string", int(self.seconds * 1000))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for batch in rows:
            out, known = [], {}  # as in FifoProcessor; what is forgotten goes between two calls, by the clock of the batch
            for rid, fp in batch.sort_values(["record_index", "record_id"])[["record_id", "fingerprint"]].itertuples(index=False):
                held = known[fp] if fp in known else self.firsts.getValue((fp,))
                known[fp] = (rid,) if held is None else held
                if held is None:
                    self.firsts.updateValue((fp,), (rid,))
                out.append((rid, fp, None if held is None else held[0]))
            yield pd.DataFrame(out, columns=["record_id", "fingerprint", "duplicate_of"])

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, shards: int, processor: StatefulProcessor, time_mode: str) -> DataFrame:
    """The rows of each shard of the fingerprints through a processor whose state is kept entry by entry."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = prepare(stream).select("record_id", "record_index", "fingerprint").withColumn("shard", F.pmod(F.xxhash64("fingerprint"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").transformWithStateInPandas(processor, processor.MADE, "append", time_mode)


def unique_fifo(stream: DataFrame, limit: int, shards: int = 64) -> DataFrame:
    """Bounded memory: each shard of the fingerprints forgets its oldest beyond limit / shards.

    Every row comes out, with duplicate_of (null for the first) and the shard's evictions so far. Rows are taken in the
    order in which they come, those of one Arrow batch in the order of record_index.
    """
    return _keyed(stream, shards, FifoProcessor(max(1, limit // shards)), "None")


def unique_recent(stream: DataFrame, seconds: float, shards: int = 64) -> DataFrame:
    """Every row with duplicate_of, the row of its fingerprint that came first in the last ``seconds`` (by the clock).

    A query with a clock always has a next batch, so start it with a processing-time trigger and not with availableNow.
    """
    return _keyed(stream, shards, RecentProcessor(seconds), "ProcessingTime")


def windowed_counts(stream: DataFrame, event_time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Rows by event-time window and keys; late rows count until the watermark passes."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))
