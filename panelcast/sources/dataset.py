"""A partitioned dataset that is repaired in place, partition by partition.

Rows lie under ``<path>/commit=<id>/<key>=<value>/...``; ``<path>/_manifests/<n>.json``
says of version n which commit holds each partition. A merge reads and writes the
partitions that its rows touch, under a commit of its own, and publishes the next
manifest last, by a rename that fails where that version is there already. Until then
nobody sees what it wrote: a merge that dies leaves the dataset as it was, one that is
run again finds nothing to add, and of two at once one fails. Untouched partitions keep
their files. The driver holds the names of partitions, never rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources import panel
from panelcast.sources.scratch import stage


@dataclass(frozen=True)
class Version:
    """A published version: its number, the rows' schema, the partition columns, and each partition's commit."""

    number: int
    schema: T.StructType
    parts: list[str]
    commits: dict[str, str]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> Version:
    """The newest published version."""
    p, fs = _path(spark, f"{path}/_manifests")
    numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")] if fs.exists(p) else []
    if not numbers:
        raise FileNotFoundError(f"no dataset at {path}")
    m = json.loads(spark.read.text(f"{path}/_manifests/{max(numbers):08d}.json", wholetext=True).first()[0])
    return Version(max(numbers), T.StructType.fromJson(m["schema"]), m["parts"], m["commits"])


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version the newest one, or fail if its number is taken."""
    text = json.dumps({"schema": version.schema.jsonValue(), "parts": version.parts, "commits": version.commits})
    staged, fs = _path(spark, f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    hadoop.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, hadoop.Path(f"{path}/_manifests/{version.number:08d}.json"), plain)


def _commit(df: DataFrame, path: str, parts: list[str]) -> dict[str, str]:
    """Write rows under a new commit; the partitions it holds."""
    spark, commit = df.sparkSession, uuid.uuid4().hex
    df.repartition(*parts).write.partitionBy(*parts).parquet(f"{path}/commit={commit}")
    p, fs = _path(spark, f"{path}/commit={commit}" + "/*=*" * len(parts))
    names = [s.getPath().toUri().getRawPath() for s in fs.globStatus(p)]
    names = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(n)).toUri().getPath() for n in names]
    return {"/".join(n.split("/")[-len(parts) :]): commit for n in names}


def create(df: DataFrame, path: str, parts: list[str]) -> Version:
    """Write the first version of a dataset."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema if f.name not in parts] + [T.StructField(c, df.schema[c].dataType) for c in parts])
    v = Version(1, schema, parts, _commit(df, path, parts))
    publish(df.sparkSession, path, v)
    return v


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, f"{path}/_manifests")
    return fs.exists(p)


def append(df: DataFrame, path: str, parts: list[str]) -> Version:
    """Add partitions to a dataset, which is created if there is none; one that is there already is an error."""
    spark = df.sparkSession
    if not exists(spark, path):
        return create(df, path, parts)
    v = current(spark, path)
    new = _commit(df.select(v.schema.names), path, parts)
    if twice := sorted(set(v.commits) & set(new)):
        raise ValueError(f"partitions are there already: {twice[:3]}")
    after = Version(v.number + 1, v.schema, v.parts, v.commits | new)
    publish(spark, path, after)
    return after


def read(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The rows of a version (the newest one); partition columns prune."""
    v = version or current(spark, path)
    if not v.commits:
        return spark.createDataFrame([], v.schema)
    paths = [f"{path}/commit={c}/{p}" for p, c in v.commits.items()]
    return spark.read.schema(v.schema).option("basePath", path).parquet(*paths).select(v.schema.names)


def _any_of(rows: list, parts: list[str]) -> Column:
    """The partitions that rows of partition values name: a predicate that prunes."""
    out = F.lit(False)
    for r in rows:
        one = F.lit(True)
        for c in parts:
            one = one & (F.col(c).isNull() if r[c] is None else F.col(c) == F.lit(r[c]))
        out = out | one
    return out


def merge(spark: SparkSession, path: str, fetched: DataFrame, key: list[str], value: str = "value") -> tuple[DataFrame, DataFrame, Version]:
    """Insert-only merge on storage: (additions, conflicts, the version after it). No additions, no new version.

    Semantics of ``panel.merge_requery``; ``fetched`` may lack nothing but has any order of columns.
    """
    v = current(spark, path)
    fetched = stage(fetched.select(v.schema.names), "fetched")
    met = read(spark, path, v).where(_any_of(fetched.select(v.parts).distinct().collect(), v.parts))
    _, add, conflicts = panel.merge_requery(met, fetched, key, value)
    add, conflicts = stage(add, "additions"), stage(conflicts, "conflicts")
    touched = add.select(v.parts).distinct().collect()
    if not touched:
        return add, conflicts, v
    rows = met.where(_any_of(touched, v.parts)).unionByName(add)
    after = Version(v.number + 1, v.schema, v.parts, v.commits | _commit(rows, path, v.parts))
    publish(spark, path, after)
    return add, conflicts, after


def repair(spark: SparkSession, path: str, fetched: DataFrame, windows: DataFrame, key: list[str], ts: str = "ts", value: str = "value") -> tuple[DataFrame, Version]:
    """Merge the fetched rows that lie in listed windows; (window, rows_returned, rows_added) and the version after it."""
    fetched = stage(fetched, "fetched")
    hit = panel.rows_in_windows(fetched, windows, ts)
    add, _, after = merge(spark, path, hit.select(fetched.columns).distinct(), key, value)
    count = lambda df, name: panel.rows_in_windows(df, windows, ts).groupBy("window").agg(F.count("*").alias(name))
    report = windows.select("window").join(count(fetched, "rows_returned"), "window", "left").join(count(add, "rows_added"), "window", "left")
    return report.na.fill(0), after


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete commits that the newest version does not name; readers of older ones must be done."""
    v = current(spark, path)
    p, fs = _path(spark, f"{path}/commit=*")
    old = [s.getPath() for s in fs.globStatus(p) if s.getPath().getName()[7:] not in set(v.commits.values())]
    for o in old:
        fs.delete(o, True)
    return sorted(o.getName()[7:] for o in old)
