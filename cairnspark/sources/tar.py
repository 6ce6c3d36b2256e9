"""Tar files as a data source: small packs share a partition when read, each pack is one tar when written."""

from __future__ import annotations

import glob
import io
import json
import os
import re
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cairnspark.sources.shared import BATCH_BYTES, small_batches

SCHEMA = "pack string, seq int, path string, kind string, size bigint, mtime bigint, mode int, target string, data_off bigint, content binary, error string"
#: The same for batches that the reader makes.
ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
#: Members that a sealed pack holds beside its files, and how pack files are named.
MANIFEST, DUPLICATES = ".archive/MANIFEST.json", ".archive/DUPLICATES.tsv"
PACK_NAME = re.compile(r"pack-([0-9]+)\.tar$")
#: Times are decimals here: nanoseconds from the year 2262 on are over a bigint.
MANIFEST_SCHEMA = (
    "format int, pack bigint, sealed_at bigint, project struct<id:string,path:string>, entries array<struct<path:string,kind:string,sha256:string,size:bigint,mtime_ns:decimal(38,0),"
    "mode:int,member:string,offset:bigint,target:string,same_as:string>>"
)


def pack_files(where: str) -> list[tuple[int, str]]:
    """(number, path) of the pack files below a folder, by number; other files are passed over."""
    found = [(int(m[1]), p) for p in glob.glob(f"{where}/**/*.tar", recursive=True) if (m := PACK_NAME.search(os.path.basename(p)))]
    return sorted(found)


def members(stream: io.BufferedIOBase, content: bool = False, only: set[str] | None = None) -> Iterator[tuple]:
    """(seq, path, kind, size, mtime, mode, target, data_off, content) of each member; damaged headers raise tarfile.TarError."""
    with tarfile.open(fileobj=stream, mode="r:") as t:
        for seq, m in enumerate(iter(t.next, None)):
            t.members.clear()  # else the headers of all members stay
            kind = "d" if m.isdir() else "l" if m.issym() else "f"
            body = t.extractfile(m).read() if content and m.isfile() and (only is None or m.name in only) else None
            yield seq, m.name, kind, m.size, int(m.mtime), m.mode, m.linkname or None, m.offset_data, body


PARTITION_BYTES, ROW_BYTES = 8 << 20, 2000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), ARROW.types)], schema=ARROW)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.where, self.content = options["path"], options.get("content", "false") == "true"
        self.only = set(json.loads(options["only"])) if "only" in options else None

    def partitions(self) -> list[InputPartition]:
        paths = [self.where] if os.path.isfile(self.where) else sorted(glob.glob(f"{self.where}/**/*.tar", recursive=True))
        out, room = [], 0
        for p in paths:  # small packs share a task, a large one has its own
            size = os.path.getsize(p)
            if not out or room < size:
                out.append(_Files([]))
                room = PARTITION_BYTES
            out[-1].paths.append(p)
            room -= size
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        """Batches of bounded bytes: else Spark gathers thousands of members with their contents before it sends any."""
        rows, room = [], BATCH_BYTES
        for r in self._rows(partition):
            rows.append(r)
            room -= len(r[9] or b"") + ROW_BYTES
            if room <= 0:
                yield _batch(rows)
                rows, room = [], BATCH_BYTES
        if rows:
            yield _batch(rows)

    def _rows(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            name = os.path.basename(path)
            try:
                with open(path, "rb") as f:
                    for m in members(f, self.content, self.only):
                        yield (name, *m, None)
            except (tarfile.TarError, OSError) as e:  # an unreadable pack is a row of its own; the others are read
                yield (name, None, None, None, None, None, None, None, None, None, f"unreadable: {e}")


class _Sealed(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Rows (pack, seq, path, kind, mtime, mode, target, content) of one pack must lie in one partition, in order of seq: see write."""

    def __init__(self, options: dict, schema: StructType):
        self.where, self.names = options["path"], schema.names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.where, exist_ok=True)
        done: list[tuple[str, str]] = []
        tar, now = None, None
        for row in rows:
            r = row.asDict()
            if r["pack"] != now:
                if tar:
                    tar.close()
                now = r["pack"]
                beside = f"{self.where}/.{os.path.basename(now)}.{uuid.uuid4().hex}.tmp"
                done.append((beside, f"{self.where}/{now}"))
                tar = tarfile.open(beside, "w", format=tarfile.PAX_FORMAT)
            m = tarfile.TarInfo(r["path"])
            m.mtime, m.mode = r["mtime"] or 0, r["mode"] or 0o644
            if r["kind"] == "d":
                m.type = tarfile.DIRTYPE
                tar.addfile(m)
            elif r["kind"] == "l":
                m.type, m.linkname = tarfile.SYMTYPE, r["target"] or ""
                tar.addfile(m)
            else:
                body = bytes(r["content"] or b"")
                m.size = len(body)
                tar.addfile(m, io.BytesIO(body))
            tar.members.clear()
        if tar:
            tar.close()
        return _Sealed(done)

    def commit(self, messages: list) -> None:
        """Packs take their names only when all tasks are done, so a lost task leaves none half written."""
        for beside, to in (x for m in messages if m for x in m.files):
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(beside, to)

    def abort(self, messages: list) -> None:
        for beside, _ in (x for m in messages if m for x in m.files):
            if os.path.exists(beside):
                os.remove(beside)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarpack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


def read(spark: SparkSession, where: str, content: bool = False, only: list[str] | None = None) -> DataFrame:
    """The members of all tars below a folder (or of one file); `content` of all or of some names only."""
    spark.dataSource.register(TarSource)
    r = spark.read.format("tarpack").option("path", where).option("content", "true" if content or only else "false")
    return (r.option("only", json.dumps(only)) if only else r).load()


def write(rows: DataFrame, where: str) -> None:
    """Packs (pack, seq, path, kind, mtime, mode, target, content) as tars in a folder: a pack goes to one task, streamed in order."""
    rows.sparkSession.dataSource.register(TarSource)
    with small_batches(rows.sparkSession):
        rows.repartition("pack").sortWithinPartitions("pack", "seq").write.format("tarpack").mode("append").option("path", where).save()


def append(path: str, rows: list[tuple[str, bytes]]) -> None:
    """Members at the end of an open pack; if one fails the file is put back to what it was."""
    size = os.path.getsize(path) if os.path.exists(path) else 0
    end, tail = 0, b""
    try:
        with tarfile.open(path, "a" if size else "w", format=tarfile.PAX_FORMAT) as t:
            end = t.offset  # the end mark of the old tar lies here
            with open(path, "rb") as f:
                f.seek(end)
                tail = f.read()
            for name, body in rows:
                m = tarfile.TarInfo(name)
                m.size = len(body)
                t.addfile(m, io.BytesIO(body))
    except BaseException:
        with open(path, "r+b") as f:
            f.seek(end)
            f.write(tail)
            f.truncate(size)
        raise


def manifests(spark: SparkSession, where: str) -> DataFrame:
    """(pack, pack_id, readable, has_manifest, project, project_path, sealed_at, entries) of each pack: its manifest read out of the tar."""
    m = read(spark, where, only=[MANIFEST])
    one = m.groupBy("pack").agg(F.bool_or(F.col("error").isNotNull()).alias("_bad"), F.max(F.when(F.col("path") == MANIFEST, F.col("content"))).alias("_m"))
    x = one.withColumn("m", F.from_json(F.col("_m").cast("string"), MANIFEST_SCHEMA))
    return x.select(
        "pack", F.regexp_extract("pack", PACK_NAME.pattern, 1).cast("long").alias("pack_id"), (~F.col("_bad")).alias("readable"), F.col("m").isNotNull().alias("has_manifest"),
        F.col("m.project.id").alias("project"), F.col("m.project.path").alias("project_path"), F.col("m.sealed_at").alias("sealed_at"), F.col("m.entries").alias("entries"),
    )


def entries(manifest: DataFrame) -> DataFrame:
    """One row for each manifest entry, in order; mtime_ns as a bigint, so where it is asked for, a time over that is an error, not null."""
    e = manifest.select("pack", "pack_id", "project", F.posexplode("entries").alias("entry", "e")).select("pack", "pack_id", "project", "entry", "e.*")
    return e.withColumn("mtime_ns", F.col("mtime_ns").cast("bigint"))


def seal(entries_: DataFrame, now: int) -> DataFrame:
    """Rows for `write` that close packs: the manifest, and the list of duplicates whose names have no tab or line end.

    entries_: pack, pack_id, seq, project, project_path, path, kind, sha256, size, mtime_ns, mode, member, offset, target, same_as.
    A pack's entries are one JSON document, so they meet in one row: a pack holds a bounded number of bytes and so of files.
    """
    e = F.struct("path", "kind", "sha256", "size", "mtime_ns", "mode", "member", "offset", "target", "same_as")
    told = entries_.groupBy("pack", "pack_id").agg(
        F.max("project").alias("project"), F.max("project_path").alias("project_path"), F.max("seq").alias("last"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", e.alias("e")))), lambda x: x["e"]).alias("entries"),
    )
    document = F.to_json(F.struct(F.lit(1).alias("format"), F.col("pack_id").alias("pack"), F.lit(now).alias("sealed_at"), F.struct(F.col("project").alias("id"), F.col("project_path").alias("path")).alias("project"), "entries"))
    clean = lambda x: ~F.coalesce(x.rlike(r"[\t\n\r]"), F.lit(True))
    copies = F.filter("entries", lambda x: x["same_as"].isNotNull() & clean(x["path"]) & clean(x["same_as"]))
    stamp = lambda x: F.date_format(F.timestamp_seconds(F.floor(x["mtime_ns"] / F.lit(1_000_000_000))), "yyyyMMddHHmm.ss")
    lines = F.array_join(F.transform(copies, lambda x: F.concat_ws("\t", x["path"], x["same_as"], x["sha256"], stamp(x))), "\n")
    both = F.array(F.struct(F.lit(MANIFEST).alias("path"), document.alias("text")), F.when(F.size(copies) > 0, F.struct(F.lit(DUPLICATES).alias("path"), F.concat(lines, F.lit("\n")).alias("text"))))
    out = told.select("pack", "last", F.posexplode(F.array_compact(both)).alias("i", "f"))
    return out.select(
        "pack", (F.col("last") + F.col("i") + 1).alias("seq"), F.col("f.path").alias("path"), F.lit("f").alias("kind"), F.lit(now).cast("bigint").alias("mtime"), F.lit(420).alias("mode"),
        F.lit(None).cast("string").alias("target"), F.col("f.text").cast("binary").alias("content"),
    )


def nested(content: bytes, content_of: set[str] | None = None) -> list[tuple]:
    """Members of a tar that is itself a member."""
    return list(members(io.BytesIO(content), content_of is not None, content_of))
