"""Plain file trees as a data source, and the JSON documents that lie in them."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cairnspark.functions import columns as c

SCHEMA = "path string, name string, kind string, size bigint, mtime_ns bigint, mode int, target string, error string"
#: Schemas of the documents; fields that are absent read as null.
CONFIG = "format int, archive_id string, created bigint, pack_target_bytes bigint, par2_redundancy_percent int, trash_days int"
JOB = "id string, title string, direction string, state string, done bigint, total bigint, current string, message string, problems array<string>, started bigint, updated bigint, rate bigint, relay string, created array<string>, locked boolean"
NOTE = "id string, name string, original string, stored string, kind string, size bigint, trashed_at bigint"
REPORT = "started bigint, finished bigint, sealed bigint, protected array<string>, scrubbed array<string>, packs_total bigint, packs_protected bigint, packs_pending bigint, packs_damaged array<string>, errors array<string>"
RECEIPT = "source string, part string, folder string, project string, files bigint, bytes bigint, checked string, stored bigint, deduplicated bigint, identical bigint, imported_at bigint"


def _row(path: str, rel: str) -> tuple:
    s = os.lstat(path)
    kind = "d" if stat.S_ISDIR(s.st_mode) else "l" if stat.S_ISLNK(s.st_mode) else "f"
    return rel, os.path.basename(rel), kind, s.st_size if kind == "f" else 0, s.st_mtime_ns, s.st_mode & 0o7777, os.readlink(path) if kind == "l" else None, None


class _Part(InputPartition):
    def __init__(self, rel: str, deep: bool):
        self.rel, self.deep = rel, deep


class _Walk(DataSourceReader):
    """Links are listed, not followed; what cannot be read is a row with its error. One partition a top-level folder."""

    def __init__(self, options: dict):
        self.top, self.deep = options["path"], options.get("recursive", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        parts = [_Part("", False)]
        if self.deep:
            parts += [_Part(e.name, True) for e in sorted(os.scandir(self.top), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        todo = [partition.rel]
        while todo:
            rel = todo.pop()
            try:
                found = sorted(os.listdir(os.path.join(self.top, rel)))
            except OSError as e:
                yield rel, os.path.basename(rel), "d", None, None, None, None, e.strerror
                continue
            for name in found:
                path = os.path.join(rel, name)
                try:
                    row = _row(os.path.join(self.top, path), path)
                except OSError as e:
                    yield path, name, None, None, None, None, None, e.strerror
                    continue
                yield row
                if row[2] == "d" and partition.deep:
                    todo.append(path)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Walk(self.options)


def walk(spark: SparkSession, top: str, recursive: bool = True) -> DataFrame:
    """Everything below a folder, with paths relative to it."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").option("path", top).option("recursive", "true" if recursive else "false").load()


def scan(spark: SparkSession, top: str, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(items, failed): what a transfer of a folder takes, without junk and excluded names and all below them, and what could not be read."""
    rows = walk(spark, top)
    out = F.exists(F.split("path", "/"), lambda p: c.excluded(p, exclude))
    return rows.where(F.col("error").isNull() & ~out).drop("error"), rows.where("error IS NOT NULL").select("path", "error")


def list_one(spark: SparkSession, folder: str, show_hidden: bool = False) -> DataFrame:
    """One folder's items, folders first; junk never, hidden ones only if asked for."""
    rows = walk(spark, folder, recursive=False).where(~c.excluded(F.col("name")))
    rows = rows if show_hidden else rows.where(~F.col("name").startswith("."))
    return rows.orderBy(F.col("kind") != "d", F.lower("name"), "name")


def documents(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """JSON documents, one a file; those that cannot be read are left out."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(where)


def open_archive(spark: SparkSession, root: str) -> dict:
    """The archive's configuration; ValueError where its format is another."""
    rows = documents(spark, f"{root}/archive.json", CONFIG).collect()
    if len(rows) != 1 or rows[0].format != 1:
        raise ValueError(f"{root} is no archive that this version reads")
    return rows[0].asDict()


def jobs(spark: SparkSession, where: str) -> DataFrame:
    return documents(spark, f"{where}/*/status.json", JOB)


def trash_notes(spark: SparkSession, notes: str, there: DataFrame) -> DataFrame:
    """Notes of what is in the trash, newest first; a note whose payload is gone is dropped."""
    return documents(spark, f"{notes}/*.json", NOTE).join(there.select(F.col("path").alias("stored")), "stored", "left_semi").orderBy(F.desc("trashed_at"), "id")


def last_report(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, REPORT)


def receipts(spark: SparkSession, where: str) -> DataFrame:
    return documents(spark, f"{where}/*.json", RECEIPT)


TABLES, VERSION = ("nodes", "projects", "contents", "blobs", "packs", "pack_entries"), 3


def save_catalog(tables: dict[str, DataFrame], where: str) -> None:
    """A version of the catalog: one Parquet folder a table, then the mark that it is whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{where}/{name}")
    spark.createDataFrame([(VERSION, ",".join(sorted(tables)))], "version int, tables string").coalesce(1).write.mode("overwrite").json(f"{where}/meta")


def open_catalog(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    """The tables of a catalog; ValueError where it is of a newer version or not whole."""
    meta = spark.read.schema("version int, tables string").json(f"{where}/meta").collect()
    if len(meta) != 1 or meta[0].version > VERSION:
        raise ValueError(f"{where} is no catalog that this version reads")
    return {t: spark.read.parquet(f"{where}/{t}") for t in meta[0].tables.split(",")}


def write_lines(lines: DataFrame, where: str) -> None:
    """A table of one text column as text files, in its order."""
    lines.write.mode("overwrite").text(where)


def as_text(nodes: DataFrame) -> DataFrame:
    """Entries as a command line shows them: kind, size, date and path in one line each; `toJSON` gives the other form."""
    size = F.when(F.col("kind") == "d", F.lit("-")).otherwise(c.human_bytes(F.col("size")))
    day = F.date_format(F.timestamp_seconds(F.floor(F.col("mtime_ns") / F.lit(1_000_000_000))), "yyyy-MM-dd")
    return nodes.select("path", F.concat(F.col("kind"), F.lit("  "), F.lpad(size, 8, " "), F.lit("  "), day, F.lit("  "), F.col("path")).alias("line"))
