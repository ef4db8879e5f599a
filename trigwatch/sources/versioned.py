"""Date-partitioned Parquet tables whose changes become visible in one step.

A table is a folder of data folders, ``table_commit=<id>/<partition>=<value>``, and of numbered
manifests in ``_versions``. A manifest names the commit that holds each partition value now. A
change writes new data folders first and then publishes the next manifest, which must not
exist yet: readers see the table before or after the change, never between, a writer that dies
before it publishes leaves only folders that nobody reads, and of two writers that start from
the same version one is refused.

Files are reached through Spark's own file systems, so any scheme that Spark knows will do. The
manifest is published by a hard link on local disks and by a rename that refuses an existing
target elsewhere. Stores without such a rename (plain object stores) need a single writer.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

COMMIT, VERSIONS = "table_commit", "_versions"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class TableConflict(RuntimeError):
    """Another writer has published the version that this one was about to publish."""


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def folder_entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder and when they were changed (seconds); none if there is no such folder."""
    system, target = _place(spark, path)
    if not system.exists(target):
        return []
    return [(f.getPath().getName(), f.getModificationTime() // 1000) for f in system.listStatus(target)]


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _place(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete_folder(spark: SparkSession, path: str) -> bool:
    system, target = _place(spark, path)
    return bool(system.delete(target, True))


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole small file unless it exists; readers never see part of it."""
    waiting = f"{path}.{uuid.uuid4().hex}.tmp"
    system, target = _place(spark, waiting)
    stream = system.create(target, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.getUri().getScheme() == "file":
        local = [spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(_place(spark, p)[1]).toString() for p in (waiting, path)]
        try:
            os.link(*local)
            return True
        except FileExistsError:
            return False
        finally:
            system.delete(target, False)
    final = _place(spark, path)[1]
    if not system.exists(final) and system.rename(target, final):
        return True
    system.delete(target, False)
    return False


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/{VERSIONS}/{version:020d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    names = [name for name, _ in folder_entries(spark, f"{path}/{VERSIONS}")]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """A version's manifest, the latest one by default; None if nothing was published."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    return json.loads(read_text(spark, _manifest_path(path, version)))


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of one version; later changes do not touch what the frame reads."""
    found = manifest(spark, path, version)
    return None if found is None else frame_of(spark, path, found)


def frame_of(spark: SparkSession, path: str, found: dict) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    folders = [f"{path}/{COMMIT}={commit}/{found['partition']}={value}" for value, commit in sorted(found["folders"].items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def publish(spark: SparkSession, path: str, after: dict | None, folders: dict[str, str], schema: StructType, partition: str) -> int:
    """Publish the version that follows ``after``; raises ``TableConflict`` if another did."""
    version = (after["version"] if after else 0) + 1
    text = json.dumps({"version": version, "partition": partition, "schema": json.loads(schema.json()), "folders": folders})
    if not put_if_absent(spark, _manifest_path(path, version), text):
        raise TableConflict(f"version {version} of {path} was published by another writer")
    return version


def write_folders(rows: DataFrame, path: str, partition: str) -> dict[str, str]:
    """Write rows into a new commit's folders, which no version names yet: partition value -> commit."""
    commit = uuid.uuid4().hex
    root = f"{path}/{COMMIT}={commit}"
    # rebalanced by date: few files per date, and a date too large for one writer is split
    rows.hint("rebalance", partition).write.partitionBy(partition).parquet(root)
    names = [name for name, _ in folder_entries(rows.sparkSession, root)]
    return {name.split("=", 1)[1]: commit for name in names if name.startswith(f"{partition}=")}


def replace_partitions(rows: DataFrame, path: str, partition: str, after: dict | None, drop: Sequence[str] = ()) -> int:
    """Publish ``after`` with the partition values of ``rows`` replaced and those of ``drop`` gone."""
    if after and after["partition"] != partition:
        raise ValueError(f"{path} is partitioned by {after['partition']}")
    new = write_folders(rows, path, partition)
    kept = {value: commit for value, commit in (after["folders"] if after else {}).items() if value not in set(drop)}
    schema = rows.schema if after is None or set(rows.columns) != set(StructType.fromJson(after["schema"]).names) else StructType.fromJson(after["schema"])
    return publish(rows.sparkSession, path, after, kept | new, schema, partition)


def drop_partitions(spark: SparkSession, path: str, after: dict, drop: Sequence[str]) -> int:
    """Publish ``after`` without some partition values; reads and writes no rows."""
    kept = {value: commit for value, commit in after["folders"].items() if value not in set(drop)}
    return publish(spark, path, after, kept, StructType.fromJson(after["schema"]), after["partition"])


def vacuum(spark: SparkSession, path: str, keep: int = 2, min_age_seconds: int = 24 * 3600) -> int:
    """Delete data that none of the last ``keep`` versions names and that is older than
    ``min_age_seconds`` (younger folders may belong to a writer that has yet to publish or to a
    reader of an older version); returns how many partition folders went."""
    known = versions(spark, path)
    if not known:
        return 0
    named = {(commit, value) for v in known[-keep:] for value, commit in manifest(spark, path, v)["folders"].items()}
    before, gone = time.time() - min_age_seconds, 0
    for v in known[:-keep]:
        delete_folder(spark, _manifest_path(path, v))
    for name, changed in folder_entries(spark, path):
        if not name.startswith(f"{COMMIT}="):
            continue
        commit, inside = name.split("=", 1)[1], folder_entries(spark, f"{path}/{name}")
        parts = [(n, at) for n, at in inside if "=" in n]
        stale = [n for n, at in parts if (commit, n.split("=", 1)[1]) not in named and at <= before]
        for part in stale:
            gone += delete_folder(spark, f"{path}/{name}/{part}")
        if len(stale) == len(parts) and changed <= before:
            delete_folder(spark, f"{path}/{name}")
    return gone
