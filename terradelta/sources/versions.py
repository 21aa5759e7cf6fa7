"""Keyed tables in versions: a version rewrites only the partitions that change, and a manifest tells which it consists of.

A table is a folder. ``v=<n>-<writer>/<partition>=<value>`` holds what one writer wrote for version n; ``_manifest/v=<n>``,
written last, has a row for each partition of version n: the folder that holds it, its number of rows, its least
and greatest key. A version counts once its manifest is complete, so readers see all of a version or nothing, a
crashed writer leaves nothing to repair, and earlier versions stay readable. Two writers that start from one version
write to folders of their own and then both try to write one manifest: the second fails, and nothing is lost.
Partitions are days or whole numbers; a manifest (a row a partition) is read by the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "part string, version long, folder string, rows long, low string, high string, note string"
#: Fixed value: the folder name that Spark gives to null.
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def _numbers(spark: SparkSession, root: str) -> dict[int, bool]:
    """The versions that have a manifest, and whether it is complete."""
    fs, at = _files(spark, f"{root}/_manifest")
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {int(n[2:]): exists(spark, f"{root}/_manifest/{n}/_SUCCESS") for n in names if n.startswith("v=")}


def newest(spark: SparkSession, root: str) -> int | None:
    """The newest complete version, or None."""
    return max((n for n, complete in _numbers(spark, root).items() if complete), default=None)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> list[Row]:
    """A version's partitions (the newest, if none is named)."""
    return [r for r in _rows(spark, root, version) if r.part is not None]


def _rows(spark: SparkSession, root: str, version: int | None) -> list[Row]:
    version = newest(spark, root) if version is None else version
    return [] if version is None else spark.read.schema(MANIFEST).parquet(f"{root}/_manifest/v={version}").collect()


def _note(rows: list[Row]) -> dict:
    return next((json.loads(r.note) for r in rows if r.part is None), {})


def tag(spark: SparkSession, root: str) -> str | None:
    """What the newest version's writer called its work."""
    return _note(_rows(spark, root, None)).get("tag")


def _read(spark: SparkSession, root: str, note: dict, parts: Sequence[Row]) -> DataFrame:
    schema = StructType.fromJson(note["schema"])
    if not parts:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{r.folder}/{note['partition']}={r.part}" for r in parts]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*schema.names)


def read_version(spark: SparkSession, root: str, version: int | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """A version of a table (the newest complete one, if none is named); ``low`` and ``high`` name the first and last
    partition to read. Other versions' files, and those of writers that didn't finish, are never listed."""
    rows = _rows(spark, root, version)
    if not rows:
        raise ValueError(f"no complete version in {root}")
    parts = [r for r in rows if r.part is not None and (low is None or r.part >= low) and (high is None or r.part <= high)]
    return _read(spark, root, _note(rows), parts)


def _part(partition: str) -> Column:
    return F.coalesce(F.col(partition).cast("string"), F.lit(NULL_PART))


def _publish(spark: SparkSession, root: str, data: DataFrame | None, kept: list[Row], note: dict) -> int:
    """Write the rows of changed partitions, then the manifest: their new files and what is kept."""
    version = max(_numbers(spark, root), default=-1) + 1
    folder, key, partition = f"v={version}-{uuid.uuid4().hex[:12]}", note["key"], note["partition"]
    parts = spark.createDataFrame([*kept, Row(part=None, version=version, folder=None, rows=0, low=None, high=None, note=json.dumps(note))], MANIFEST)
    if data is not None:
        # AQE cuts large partitions and joins small ones, so that a hot day isn't one task.
        data.hint("rebalance", partition).write.partitionBy(partition).parquet(f"{root}/{folder}")
        new = spark.read.schema(data.schema).parquet(f"{root}/{folder}").groupBy(_part(partition).alias("part"))
        bound = lambda f: f(F.col(key).cast("string"))
        new = new.agg(F.count("*").alias("rows"), bound(F.min).alias("low"), bound(F.max).alias("high"))
        parts = parts.unionByName(new.select("part", F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), "rows", "low", "high", F.lit(None).cast("string").alias("note")))
    parts.coalesce(1).write.mode("errorifexists").parquet(f"{root}/_manifest/v={version}")  # a row a partition
    return version


def write_version(data: DataFrame, root: str, key: str, partition: str, tag: str | None = None) -> int:
    """A new version that holds just ``data``. Returns its number, as the other writers do."""
    note = {"schema": data.schema.jsonValue(), "key": key, "partition": partition, "tag": tag}
    return _publish(data.sparkSession, root, data, [], note)


def upsert_version(changed: DataFrame, root: str, tag: str | None = None) -> int:
    """A new version in which the rows of ``changed`` (keys distinct) stand in place of those with their key. A key may
    move to another partition. If ``tag`` is that of the newest version, the work was done: nothing is written.

    Rewritten are the partitions of the new rows and those that held their keys. To find these, the manifest's key bounds
    rule out partitions, and only keys of the others are read.
    """
    spark = changed.sparkSession
    rows = _rows(spark, root, None)
    note, parts = _note(rows), [r for r in rows if r.part is not None]
    if tag is not None and note.get("tag") == tag:
        return newest(spark, root)
    key, partition = note["key"], note["partition"]
    low, high, n = changed.agg(F.min(F.col(key).cast("string")), F.max(F.col(key).cast("string")), F.count("*")).first()
    if not n:
        return _publish(spark, root, None, parts, note | {"tag": tag})
    near = [r for r in parts if low is not None and r.low is not None and r.low <= high and r.high >= low]
    held = _read(spark, root, note, near).select(key, partition).join(changed.select(key), key, "left_semi")
    touched = {r.part for r in held.select(_part(partition).alias("part")).unionByName(changed.select(_part(partition).alias("part"))).distinct().collect()}
    old = _read(spark, root, note, [r for r in parts if r.part in touched])
    data = old.join(changed.select(key), key, "left_anti").unionByName(changed.select(*old.columns))
    return _publish(spark, root, data.select(*old.columns), [r for r in parts if r.part not in touched], note | {"tag": tag})


def keep_version(pulled: DataFrame, root: str, since: str, tag: str | None = None) -> int:
    """A new version without the rows of partitions from ``since`` on whose key ``pulled`` lacks. Partitions that lose
    nothing aren't rewritten, and those that lose all of their rows just leave the manifest."""
    spark = pulled.sparkSession
    rows = _rows(spark, root, None)
    note, parts = _note(rows), [r for r in rows if r.part is not None]
    key, partition = note["key"], note["partition"]
    recent = [r for r in parts if r.part >= since and r.part != NULL_PART]
    keys = pulled.select(key).distinct()
    lost = _read(spark, root, note, recent).select(key, partition).join(keys, key, "left_anti").groupBy(_part(partition).alias("part")).agg(F.count("*").alias("n"))
    lost = {r.part: r.n for r in lost.collect()}
    left = [r for r in recent if r.part in lost and lost[r.part] < r.rows]
    data = _read(spark, root, note, left).join(keys, key, "left_semi") if left else None
    return _publish(spark, root, data, [r for r in parts if r.part not in lost], note | {"tag": tag})


def expire_version(spark: SparkSession, root: str, before: str, tag: str | None = None) -> int:
    """A new version without the partitions before ``before``: only the manifest is written. Nothing to drop: no version."""
    rows = _rows(spark, root, None)
    note = _note(rows)
    old = [r for r in rows if r.part is not None and r.part < before]
    if not old:
        return newest(spark, root)
    gone = {r.part for r in old}
    return _publish(spark, root, None, [r for r in rows if r.part is not None and r.part not in gone], note | {"tag": note.get("tag") if tag is None else tag})


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete what none of the ``keep`` newest complete versions needs: older manifests, and partitions that only
    those named. No one may be reading older versions, or writing. Returns the folders deleted."""
    complete = sorted(n for n, done in _numbers(spark, root).items() if done)[-keep:]
    if not complete:
        return []
    needed, partition = set(), None
    for n in complete:
        rows = _rows(spark, root, n)
        partition = _note(rows)["partition"]
        needed |= {(r.folder, f"{partition}={r.part}") for r in rows if r.part is not None}
    gone = []

    def drop(path: str) -> None:
        fs, at = _files(spark, path)
        fs.delete(at, True)
        gone.append(path)

    for n in _numbers(spark, root):
        if n not in complete:
            drop(f"{root}/_manifest/v={n}")
    fs, at = _files(spark, root)
    for folder in [s.getPath().getName() for s in fs.listStatus(at)]:
        if folder.startswith("v="):
            for name in [s.getPath().getName() for s in fs.listStatus(_files(spark, f"{root}/{folder}")[1])]:
                if name.startswith(f"{partition}=") and (folder, name) not in needed:
                    drop(f"{root}/{folder}/{name}")
    return gone
