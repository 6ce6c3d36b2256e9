"""A folder for files that tasks write and later ones read, and files that are replaced as a whole."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes of rows that go to a Python worker at a time; Spark's own bound is 64 MB, of which a worker holds several copies.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_batches_small(spark: SparkSession) -> str:
    """From now on the session sends rows to Python in batches of BATCH_BYTES at most; a smaller bound stays. Returns the one before.

    What a worker holds then follows from its largest row, not from how many rows its partition has. Results don't depend on it.
    """
    before = spark.conf.get(_BATCH)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The same for a step that runs within."""
    before = keep_batches_small(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; it goes when the driver's JVM ends.

    Where the setting is absent, a temporary folder, on a local master only: on a cluster each machine would have its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cairnspark.work.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cairnspark-")
        spark.conf.set("cairnspark.work.dir", base)
    path = f"{base.removeprefix('file://')}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    os.makedirs(path, exist_ok=True)
    return path


def replace_file(path: str, data: bytes) -> None:
    """The file is the old one or the new one at any time: written beside it, synced, then renamed."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def write_document(path: str, document: dict) -> None:
    """One JSON document (configuration, status, receipt, report), replaced as a whole."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    replace_file(path, json.dumps(document, ensure_ascii=False, indent=2).encode())


class PartFile:
    """A file received in pieces: the part beside it keeps what has arrived, so a broken transfer goes on where it stopped."""

    def __init__(self, path: str):
        self.path, self.part = path, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.part")

    def have(self) -> int:
        return os.path.getsize(self.part) if os.path.exists(self.part) else 0

    def write(self, offset: int, data: bytes) -> int:
        """Bytes from an offset; what was written beyond it before is cut off. An offset past the end is refused."""
        if offset > self.have():
            raise ValueError(f"{offset} is past the {self.have()} bytes that have arrived")
        with open(self.part, "r+b" if os.path.exists(self.part) else "w+b") as f:
            f.truncate(offset)
            f.seek(offset)
            f.write(data)
        return offset + len(data)

    def finish(self, sha256: str) -> bool:
        """Takes its name if the whole has this digest; else the part goes and the transfer starts anew."""
        import hashlib

        with open(self.part, "rb") as f:
            same = hashlib.file_digest(f, "sha256").hexdigest() == sha256
        if same:
            os.replace(self.part, self.path)
        else:
            os.remove(self.part)
        return same


def append_line(path: str, line: str) -> None:
    """One line at the end of a log, in one write."""
    with open(path, "ab") as f:
        f.write(line.rstrip("\n").encode() + b"\n")
