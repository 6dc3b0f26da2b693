"""Panels from streams; each operator equals its batch twin on the rows that are not late."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelcast.operators import carry
from panelcast.sources import panel
from panelcast.sources.scratch import new_path, stage


def read_events(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A folder or file of event rows as a stream, with a stamp that watermarks accept."""
    schema = spark.read.parquet(path).schema
    # as a glob, since a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(ts, F.col(ts).cast("timestamp"))


@dataclass
class ByBatch:
    """A stream whose batches are turned into rows of ``schema`` by ``work(batch, n)``, which is called again if batch n is run again."""

    stream: DataFrame
    schema: str
    work: Callable[[DataFrame, int], DataFrame]


def run_once(stream: DataFrame | ByBatch, mode: str = "append") -> DataFrame:
    """All rows available now through the stream into a table of the shared folder (append), read back."""
    spark = (stream.stream if isinstance(stream, ByBatch) else stream).sparkSession
    out, mark = new_path(spark, "stream"), new_path(spark, "checkpoint")
    if isinstance(stream, ByBatch):
        def put(batch: DataFrame, n: int) -> None:
            stream.work(batch, n).write.mode("overwrite").parquet(f"{out}/batch={n}")

        spark.createDataFrame([], stream.schema).write.parquet(f"{out}/none")
        stream.stream.writeStream.foreachBatch(put).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/*")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)
    return got


def run_until_forgotten(stream: DataFrame, seconds: float = 600.0, trigger: str = "1 second") -> DataFrame:
    """A stream with timers into a table of the shared folder, until no key has state left (or ``seconds`` have passed: an error)."""
    spark = stream.sparkSession
    out, mark, provider = new_path(spark, "stream"), new_path(spark, "checkpoint"), "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers and expiry need it
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(processingTime=trigger).start()
    finally:
        spark.conf.unset(provider) if was is None else spark.conf.set(provider, was)
    try:
        end, rows = time.time() + seconds, 0
        while q.isActive:
            done = [p for p in q.recentProgress if p["stateOperators"]]
            rows = sum(p["numInputRows"] for p in done)
            if rows and done[-1]["numInputRows"] == 0 and done[-1]["stateOperators"][0]["numRowsTotal"] == 0:
                break
            if time.time() > end:
                raise TimeoutError(f"state is left after {seconds} seconds and {rows} rows")
            time.sleep(0.3)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)


def hourly_collapse(stream: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "2 hours") -> DataFrame:
    """Mean and slots of each hour; slots may come as late as the watermark."""
    g = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 hour").alias("w")).agg(F.avg(value).alias("value"), F.count(value).alias("slots"))
    return g.select(*keys, F.col("w.start").alias("hour"), "value", "slots")


def dedupe(stream: DataFrame, key: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """One row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def insert_only_merge(base: DataFrame, key: list[str], merged_path: str, conflict_path: str, value: str = "value", part: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of new keys are appended, conflicts go to a table of their own.

    ``part``, an expression of the key (its month, its zone), cuts the merged table: a
    batch reads the parts of base and table that its rows fall into, however many
    batches came before. Without it all rows are one part. Of rows that share a key
    within a batch the first by value and other columns counts, the others are compared
    with it. Each part's rows lie in a folder named by the batch's number, so a batch that
    is run again replaces what it wrote and does not see it. ``merge.read`` lists the
    bytes of the merged table that each batch read.
    """
    part = F.lit("all") if part is None else part.cast("string")

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = stage(batch.select(base.columns).withColumn("_part", part), "batch")
        touched = [r[0] for r in batch.select("_part").distinct().collect()]  # parts of one batch
        names = {p: "part=" + hashlib.md5(str(p).encode()).hexdigest() for p in touched}
        seen = base.withColumn("_part", part).where(F.col("_part").isin([p for p in touched if p is not None]) | (F.col("_part").isNull() if None in touched else F.lit(False))).drop("_part")
        hadoop, conf, old, size = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), [], 0
        for name in names.values():
            p = hadoop.Path(f"{merged_path}/{name}")
            fs = p.getFileSystem(conf)
            if fs.exists(p):
                old += [f.getPath().toString() for f in fs.listStatus(p) if int(f.getPath().getName()[6:]) < n]
        if old:
            seen = seen.unionByName(spark.read.schema(base.schema).parquet(*old))
            size = sum(int(hadoop.Path(o).getFileSystem(conf).getContentSummary(hadoop.Path(o)).getLength()) for o in old)
        merge.read.append(size)
        rest = [c for c in base.columns if c not in key]
        order = [value, *[c for c in rest if c != value]]
        one = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*[F.struct(F.col(c).isNull(), c) for c in order])).alias("_r")).select(*key, "_r.*").select(base.columns)
        _, add, _ = panel.merge_requery(seen, one, key, value)
        add = stage(add.withColumn("_part", part), "add")
        for p, name in names.items():
            add.where(F.col("_part").eqNullSafe(F.lit(p))).drop("_part").write.mode("overwrite").parquet(f"{merged_path}/{name}/batch={n}")
        kept = seen.select(*key, value).unionByName(add.select(*key, value))
        both, same = kept.alias("k").join(batch.select(*key, value).distinct().alias("b"), [F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]), F.col(f"k.{value}").eqNullSafe(F.col(f"b.{value}"))
        both = both.where(~same).select(*[F.col(f"k.{c}").alias(c) for c in key], F.col(f"k.{value}").alias("kept"), F.col(f"b.{value}").alias("fetched"))
        both.write.mode("overwrite").parquet(f"{conflict_path}/batch={n}")

    merge.read = []
    return merge


def merged_rows(spark: SparkSession, merged_path: str, like: DataFrame) -> DataFrame:
    """All rows that a merge has added so far."""
    return spark.read.schema(like.schema).parquet(f"{merged_path}/*/*")


def running_mae(forecasts: DataFrame, observed: DataFrame, on: list[str], keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """(keys, mae, n) so far, from a stream-stream join on ``on`` and stamp; the state is one sum and count for each of ``keys``. Each batch gives a row for each key it touched; ``latest`` keeps the last."""
    f = forecasts.withWatermark(ts, late).select(*on, F.col(ts).alias("_tf"), "forecast")
    o = observed.withWatermark(ts, late).select(*[F.col(k).alias(f"_{k}") for k in on], F.col(ts).alias("_to"), "observed")
    cond = F.col("_tf") == F.col("_to")
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    j = f.join(o, cond).select(*keys, F.abs(F.col("observed") - F.col("forecast")).alias("error")).where("error IS NOT NULL")

    def add(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        for part in frames:
            total, n = total + float(part["error"].sum()), n + len(part)
        state.update((total, n))
        yield pd.DataFrame({**{c: [v] for c, v in zip(keys, k, strict=True)}, "mae": [total / n], "n": [n]})

    kinds = dict(j.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "mae double, n long"])
    return j.groupBy(*keys).applyInPandasWithState(add, schema, "total double, n long", "append", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The last of each key's updates: the one that counts most rows."""
    rest = [c for c in updates.columns if c not in (*keys, n, "batch")]
    g = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), n).alias("_r"), F.max(n).alias(n))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], n)


def step_hold(stream: DataFrame, key: str, ts: str = "ts", level: str = "level", seq: str | None = None, state: str | None = None, width: int = 86400) -> ByBatch:
    """Each row with the last level of its key published so far, (key, ts, level), for ``run_once``; one number of state a key.

    Rows of a batch are taken in order of their stamps, then of ``seq``; a row older than
    the state's stamp sees the level without changing it; one without a stamp comes last
    in its batch and is not remembered. A batch is scanned by buckets of ``width`` seconds,
    so a key's rows are spread over tasks. The state is a table in the folder ``state``,
    written anew for each batch: one that is run again starts from the batch before.
    """
    spark = stream.sparkSession
    state, staged = state or new_path(spark, "levels"), new_path(spark, "batch")
    kind = dict(stream.dtypes)[key]
    schema = f"_k {kind}, _at long, _now double"

    def work(batch: DataFrame, n: int) -> DataFrame:
        spark, hadoop = batch.sparkSession, batch.sparkSession._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(state).getFileSystem(spark._jsc.hadoopConfiguration())
        versions = [int(f.getPath().getName()[6:]) for f in fs.listStatus(hadoop.Path(state))] if fs.exists(hadoop.Path(state)) else []
        old = sorted(i for i in versions if i < n)
        held = spark.read.schema(schema).parquet(f"{state}/batch={old[-1]}") if old else spark.createDataFrame([], schema)
        stamp = F.unix_micros(F.col(ts).cast("timestamp"))
        rows = batch.select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"), F.coalesce(stamp, F.lit(2**63 - 1)).alias("_t"), (F.col(seq) if seq else F.lit(0)).alias("_seq"), F.col(level).cast("double").alias("_level"))
        rows.write.mode("overwrite").parquet(staged)  # the rows of the batch before are no longer needed
        rows = spark.read.schema(rows.schema).parquet(staged).join(held, F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
        rows = rows.withColumn("_new", F.when(F.col("_at").isNull() | (F.col("_t") >= F.col("_at")), F.col("_level")))
        when = F.when(F.col("_new").isNotNull() & F.col("_ts").isNotNull(), F.struct("_t", "_seq"))
        new = rows.groupBy(F.col("_key").alias("_k")).agg(F.max(when)["_t"].alias("_at"), F.max_by("_new", when).alias("_now")).where("_at IS NOT NULL")
        kept = held.alias("h").join(new.alias("n"), F.col("h._k").eqNullSafe(F.col("n._k")), "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{state}/batch={n}")
        for i in old[:-1]:
            fs.delete(hadoop.Path(f"{state}/batch={i}"), True)
        out = carry.scan(rows, ["_key"], "_t", back={"_held": F.col("_new")}, order=("_seq",), width=width * 1_000_000)
        return out.select(F.col("_key").alias(key), F.col("_ts").alias("ts"), F.coalesce("_held", "_now").alias("level"))

    return ByBatch(stream, f"{key} {kind}, ts timestamp, level double", work)


def sessions(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of activity; one that has ended without a successor is a stalled run."""
    g = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("rows"))
    return g.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("stalled_at"), "rows")


def rolling_week(stream: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and deviation over sliding weeks."""
    g = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, "7 days", slide).alias("w")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return g.select(*keys, F.col("w.end").alias("end"), "mean", "std")


class _Runs(StatefulProcessor):
    """One run (start, last stamp, rows) of state a key; a timer ends it when no row has come for ``wait`` milliseconds."""

    def __init__(self, ts: str, gap: float, wait: int, forget: int):
        self.ts, self.gap, self.wait, self.forget = ts, pd.Timedelta(seconds=gap), wait, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start timestamp, last timestamp, rows long", self.forget)

    def _row(self, key: tuple, start: pd.Timestamp, last: pd.Timestamp, rows: int, stalled: bool) -> dict:
        return {"key": key[0], "start": start, "ended_at": last + self.gap, "rows": rows, "stalled": stalled}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = pd.concat([r[self.ts] for r in rows]).sort_values()
        old = self.run.get() if self.run.exists() else None
        out, now = [], None if old is None else (pd.Timestamp(old[0]), pd.Timestamp(old[1]), int(old[2]))
        # runs of this batch, the first of which may go on with the one in state
        for _, part in at.groupby((at.diff() >= self.gap).cumsum().to_numpy()):
            first, last, n = part.iloc[0], part.iloc[-1], len(part)
            if now is not None and first < now[1] + self.gap:
                now = (min(now[0], first), max(now[1], last), now[2] + n)
            else:
                if now is not None:
                    out.append(self._row(key, *now, False))
                now = (first, last, n)
        self.run.update((now[0].to_pydatetime(), now[1].to_pydatetime(), now[2]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield pd.DataFrame(out, columns=["key", "start", "ended_at", "rows", "stalled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.run.exists():
            start, last, n = self.run.get()
            out.append(self._row(key, pd.Timestamp(start), pd.Timestamp(last), int(n), True))
            self.run.clear()
        yield pd.DataFrame(out, columns=["key", "start", "ended_at", "rows", "stalled"])

    def close(self) -> None:
        pass


def stalled_runs(stream: DataFrame, key: str, ts: str = "ts", gap: float = 1800, wait: float = 1800, forget: float = 7 * 86400) -> DataFrame:
    """(key, start, ended_at, rows, stalled): runs of rows whose stamps follow within ``gap`` seconds.

    A run ends when a later one of its key begins (not stalled), or when no row of the
    key has come for ``wait`` seconds by the clock (stalled): a timer fires without any
    further input, so a source that stops as a whole is reported. A row that comes after
    that begins a run of its own. State that no timer has ended expires after ``forget``
    seconds. Rows of a batch are taken in order of their stamps; one that is older than
    the run in state joins it. Null stamps take no part.
    """
    kind = dict(stream.dtypes)[key]
    schema = f"key {kind}, start timestamp, ended_at timestamp, rows long, stalled boolean"
    rows = stream.where(F.col(ts).isNotNull()).select(key, ts)
    out = rows.groupBy(key).transformWithStateInPandas(_Runs(ts, gap, int(wait * 1000), int(forget * 1000)), schema, "Append", "ProcessingTime")
    return out.withColumnRenamed("key", key)
