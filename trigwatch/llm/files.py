"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


#: names that Spark gives to stores, and those under which pyarrow reaches the same place
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "gs": "gs", "s3": "s3", "abfss": "abfss", "hdfs": "hdfs", "file": "file"}


def plain_path(path: str) -> str:
    """The path as pyarrow names it; raises for a store that tasks cannot write to."""
    if "://" not in path and path.startswith("file:"):
        return "file://" + path[len("file:"):]
    if path.startswith(("dbfs:/", "/")):  # the former is mounted on every machine
        return "/dbfs/" + path[len("dbfs:/"):].lstrip("/") if path.startswith("dbfs:") else path
    scheme, rest = path.split("://", 1) if "://" in path else ("", path)
    if scheme not in SCHEMES:
        raise ValueError(f"tasks cannot write files to {path!r}: name a shared folder on {', '.join(sorted(SCHEMES))} or a mounted path in spark.checkpoint.dir")
    return f"{SCHEMES[scheme]}://{rest}"


def check_folder(path: str) -> str:
    """``path``, after making sure, before any work, that files can be reached below it."""
    _at(path)
    return path


def _at(path: str):
    return fs.FileSystem.from_uri(plain_path(path))


def new_file(folder: str, part: int, suffix: str):
    """Open a file whose name no other attempt of the task uses; returns its path and stream.

    The path goes into the manifest only when its task succeeds, so what a lost or repeated
    attempt has written is never read.
    """
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.{suffix}"
    system, inner = _at(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return path, system.open_output_stream(inner, compression=None)


def open_file(path: str):
    """A seekable stream over the file."""
    system, inner = _at(path)
    return system.open_input_file(inner)
