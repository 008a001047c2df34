"""Linking signals as they come: two streams, one keyed by reference number and one by institution.

The first settles numbers: each batch is joined with a table of first holders, to which its own numbers are
added, and is written with the root and the institution that it is to be decided in. The second keeps the
threads of an institution as state, so that a batch is decided without the signals before it. Batches that
come in the order of their signals give what linkage.link() gives for all at once; a later one with older
signals is decided when it comes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import linkage
from ..storage import exists, release, written

_HOLDERS = "key string, first struct<observed_at: date, signal_id: long>, root long, home string, batch long"
ROOTED = (
    "signal_id long, institution_code string, stage string, category string, budget_krw long, observed_at date, order_plan_no string, prespec_no string, bid_notice_no string, cancels_bid_notice_no string, "
    "embedding array<double>, bare string, terms array<string>, rank int, root long, home string"
)


def settle_numbers(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes a batch of signals, with roots and homes, to path/rooted, and its numbers' first holders to path/holders.

    A batch that was written whole is not written again; one that broke off is written anew, so that a replay
    changes nothing. Null and empty numbers decide nothing.
    """
    spark, out = batch.sparkSession, f"{path}/rooted/batch={batch_id}"
    if exists(spark, f"{out}/_SUCCESS"):
        return
    signals = written(batch, "signals")
    own = linkage.first_holders(signals)
    holders = own.withColumns({"root": F.lit(None).cast("long"), "home": F.lit(None).cast("string")})
    if exists(spark, f"{path}/holders"):
        known = spark.read.schema(_HOLDERS).parquet(f"{path}/holders").where(F.col("batch") < batch_id).drop("batch")
        holders = holders.union(known.join(linkage.keys(signals), "key", "left_semi"))
    holders = holders.groupBy("key").agg(F.min(F.struct("first", "root", "home")).alias("m")).select("key", "m.*")
    found = linkage.parents(signals, holders).select("signal_id", "parent", "root", "home")
    at = F.coalesce(F.concat(F.lit("at:"), "institution_code"), F.concat(F.lit("one:"), F.col("signal_id").cast("string")))
    joined = signals.select("signal_id", at.alias("own")).join(found, "signal_id", "left")
    steps = [written(joined.select("signal_id", F.coalesce("root", "parent", "signal_id").alias("root"), F.when(F.col("parent").isNull(), F.col("own")).otherwise(F.col("home")).alias("home")), "rooted")]
    while steps[-1].where("home is null").limit(1).count():
        ahead = steps[-1].select(F.col("signal_id").alias("root"), F.col("root").alias("further"), F.col("home").alias("there"))
        steps.append(written(steps[-1].join(ahead, "root", "left").select("signal_id", F.coalesce("further", "root").alias("root"), F.coalesce("home", "there").alias("home")), "rooted"))
    rooted = steps[-1]
    # Keys whose first holder is of an earlier batch have a root already and stay as they are.
    new = holders.where("root is null").drop("root", "home").join(rooted.select(F.col("signal_id").alias("id"), "root", "home"), F.col("first.signal_id") == F.col("id")).drop("id")
    new.write.mode("overwrite").parquet(f"{path}/holders/batch={batch_id}")
    columns = [c.split()[0] for c in ROOTED.split(", ")]
    linkage.prepared(signals).join(rooted, "signal_id").select(*columns).write.mode("overwrite").parquet(out)
    for table in (signals, *steps):
        release(table)


def intake(signals: DataFrame, path: str) -> StreamingQuery:
    """Starts the stream that settles the numbers of signals; ends when all there is has been read."""
    stream = signals.writeStream.foreachBatch(lambda batch, batch_id: settle_numbers(batch, batch_id, path))
    return stream.option("checkpointLocation", f"{path}/intake").trigger(availableNow=True).start()


class _Found(dict):
    """Threads of roots: those of this batch, then those in state."""

    def __init__(self, state) -> None:
        super().__init__()
        self._state = state

    def __missing__(self, root: int) -> int:
        return self._state.getValue((root,))[0]


class Linker(StatefulProcessor):
    """The threads of an institution: their columns in one value, each thread in a map, loaded when it is looked at."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._columns = handle.getValueState("columns", "value binary")
        self._threads = handle.getMapState("threads", "at int", "value binary")
        self._found = handle.getMapState("found", "root long", "at int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001 - names of Spark
        columns = pickle.loads(self._columns.get()[0]) if self._columns.exists() else ()
        place = linkage.Place(*columns, load=lambda at: pickle.loads(self._threads.getValue((int(at),))[0]))
        found = _Found(self._found)
        out = linkage.fold(pd.concat(list(rows)), place, found)
        for at in sorted(place.changed):
            self._threads.updateValue((int(at),), (pickle.dumps(place.thread(at)),))
        for root, at in found.items():
            self._found.updateValue((int(root),), (int(at),))
        self._columns.update((pickle.dumps(place.columns()),))
        yield out

    def close(self) -> None:
        pass


def links(spark: SparkSession, path: str) -> DataFrame:
    """The stream of links of what intake() wrote, as linkage.link() gives them. Its state needs RocksDB, which must be set:
    spark.sql.streaming.stateStore.providerClass."""
    rooted = spark.readStream.schema(ROOTED).parquet(f"{path}/rooted")
    return rooted.groupBy("home").transformWithStateInPandas(Linker(), linkage.LINK, "Append", "None")
