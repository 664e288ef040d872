"""Custom state over streams: a cache with expiry and LRU, a workflow's state machine, and a derived table kept up to date.

State lives in Spark's state store and survives restarts; what is fed is given
in slices, each of which a query run takes from where the last one stopped.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: The stages of a workflow in order, those that may go back to planning, and its outcomes.
STAGES = ["initial", "planning", "retrieving", "analyzing", "verifying", "synthesizing", "completed"]
REFINABLE = ["retrieving", "verifying"]
SUCCESS, NO_RESULTS, NEEDS_REFINEMENT, FATAL_ERROR = "success", "no_results", "needs_refinement", "fatal_error"
FAILED = "failed"
MOST_REFINEMENTS = 2


def with_state(events: DataFrame, by: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The stream's rows through a processor with state for each ``by``; the state store that this needs is set for the session."""
    events.sparkSession.conf.set(_STORE, _ROCKS)
    return events.groupBy(by).transformWithStateInPandas(processor, schema, "Append", "None")


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """What a micro-batch has for one key, by time and number: the trigger bounds it."""
    return pd.concat(batches).sort_values(["ts", "number"], kind="stable")


class Cache(StatefulProcessor):
    """Looks each row's item up in a cache of ``size`` items, and puts it there if it is missing or older than ``seconds``.

    A look-up moves an item to the end but doesn't renew it; what is over
    ``size`` goes from the front. Rows: item, ts, number. Out: number, item and
    whether it was a ``hit``, ``expired`` or a ``miss``.
    """

    SCHEMA = "cache string, number bigint, item bigint, result string"

    def __init__(self, size: int, seconds: int):
        self.size, self.seconds = size, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", "items array<bigint>, since array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.entries.get() if self.entries.exists() else ([], [])
        entries: OrderedDict[int, int] = OrderedDict(zip(held[0], held[1]))
        frame = _in_order(rows)
        out = []
        for item, at in zip(frame["item"].tolist(), frame["ts"].astype("datetime64[us]").astype("int64").tolist()):
            since = entries.get(item)
            result = "miss" if since is None else "expired" if since + self.seconds * 1_000_000 <= at else "hit"
            if result != "hit":
                entries[item] = at
            entries.move_to_end(item)
            while len(entries) > self.size:
                entries.popitem(last=False)
            out.append(result)
        self.entries.update((list(entries), list(entries.values())))
        yield pd.DataFrame({"cache": key[0], "number": frame["number"], "item": frame["item"], "result": out})

    def close(self) -> None:
        pass


def moved(stage: str, refinements: int, outcome: str) -> tuple[str, int, bool]:
    """(stage, refinements, whether the step is allowed) after an outcome; a step that isn't allowed changes nothing."""
    if stage in (STAGES[-1], FAILED):
        return stage, refinements, False
    if outcome == FATAL_ERROR:
        return FAILED, refinements, True
    if outcome == SUCCESS:
        return STAGES[STAGES.index(stage) + 1], refinements, True
    if outcome in (NO_RESULTS, NEEDS_REFINEMENT) and stage in REFINABLE:
        return ("planning", refinements + 1, True) if refinements < MOST_REFINEMENTS else (FAILED, refinements, True)
    return stage, refinements, False


class Workflow(StatefulProcessor):
    """Each key's workflow, moved by its rows' outcomes; rows: outcome, ts, number. Out: the stage after each row, and whether its step was allowed."""

    SCHEMA = "workflow string, number bigint, outcome string, stage string, refinements int, allowed boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "stage string, refinements int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stage, refinements = self.at.get() if self.at.exists() else (STAGES[0], 0)
        frame = _in_order(rows)
        out = []
        for outcome in frame["outcome"]:
            stage, refinements, allowed = moved(stage, refinements, outcome)
            out.append((stage, refinements, allowed))
        self.at.update((stage, refinements))
        done = pd.DataFrame(out, columns=["stage", "refinements", "allowed"])
        yield pd.DataFrame({"workflow": key[0], "number": frame["number"].to_numpy(), "outcome": frame["outcome"].to_numpy(), "stage": done["stage"], "refinements": done["refinements"].astype("int32"), "allowed": done["allowed"]})

    def close(self) -> None:
        pass


def slices(rows: DataFrame, time: str, parts: int) -> list[DataFrame]:
    """The rows in ``parts`` ranges of time, about equal in number; null times are in the first."""
    cuts = rows.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] if parts > 1 else []
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62)))
    bounds = [-(1 << 62) - 1, *(cuts or []), 1 << 62]
    return [rows.where((at > a) & (at <= b)) for a, b in zip(bounds, bounds[1:])]


def fed(parts: list[DataFrame], folder: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that ``plan`` gives for a stream of the parts, one after the other.

    Each part is written as files of its own, and the query is started anew
    from its checkpoint to take them, so that state, watermark and progress
    come from storage every time.
    """
    spark: SparkSession = parts[0].sparkSession
    schema = parts[0].schema
    out = None
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part={i}")
        stream = plan(spark.readStream.schema(T.StructType([*schema, T.StructField("part", T.IntegerType())])).parquet(f"{folder}/in").drop("part"))
        out = stream.schema
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(f"{folder}/out")


class Maintained:
    """A table derived from a stream of changes, as a folder of what each micro-batch changed.

    Only rows whose content differs from the table's are written, so a batch
    costs what it changes; the table is each key's newest row. A batch that is
    delivered again replaces its own folder and is compared with the batches
    before it, so nothing changes. ``compact`` joins the folders into one.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        """``schema`` are the table's columns beside batch, digest and gone."""
        self.spark, self.folder, self.key = spark, folder, key
        fields = T.StructType.fromDDL(schema)
        self.schema = T.StructType([*fields, T.StructField("digest", T.StringType()), T.StructField("gone", T.BooleanType()), T.StructField("batch", T.LongType())])
        spark.createDataFrame([], T.StructType(self.schema[:-1])).write.mode("overwrite").parquet(f"{folder}/batch=-1")

    def changes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def table(self, before: int | None = None) -> DataFrame:
        """The newest row of each key, gone ones left out; as of before a batch, if one is given."""
        rows = self.changes() if before is None else self.changes().where(F.col("batch") < before)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key]), "batch").alias("r"))
        return newest.where("NOT r.gone").select(self.key, "r.*").select(rows.columns).drop("gone")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes a batch(columns of the table, gone, order): a key's last row by ``order`` counts; rows without a key are left out."""
        content = [c for c in self.schema.names if c not in (self.key, "digest", "gone", "batch")]
        by = Window.partitionBy(self.key).orderBy(F.desc("order"))
        last = batch.where(F.col(self.key).isNotNull()).withColumn("n", F.row_number().over(by)).where("n = 1")
        digest = F.sha2(F.to_json(F.struct(*content)).cast("binary"), 256)
        last = last.select(self.key, *content, digest.alias("digest"), F.coalesce("gone", F.lit(False)).alias("gone"))
        known = self.table(number).select(self.key, F.col("digest").alias("old"))
        new = last.join(known, self.key, "left").where(F.when(F.col("gone"), F.col("old").isNotNull()).otherwise(~F.col("digest").eqNullSafe(F.col("old")))).drop("old")
        new.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes what there is of the stream now."""
        stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def compact(self, into: str) -> Maintained:
        """The table without its history, in another folder."""
        kept = [f for f in self.schema if f.name not in ("digest", "gone", "batch")]
        out = Maintained(self.spark, into, self.key, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))
        self.table().withColumn("gone", F.lit(False)).select([f.name for f in self.schema if f.name != "batch"]).write.mode("overwrite").parquet(f"{into}/batch=0")
        return out
