"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ROW_GROUP = 16 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text read as empty; other columns are dropped, so their names cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mapped(d: DataFrame, run, schema: str, key: str = "doc_id") -> DataFrame:
    """d.mapInPandas with the key as text on the way: pandas would make fractions of whole numbers that have nulls among them."""
    out = d.withColumn(key, F.col(key).cast("string")).mapInPandas(run, f"{key} string, {schema}")
    return out.withColumn(key, F.col(key).cast(d.schema[key].dataType))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(id_col: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == 2


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased words as UTF-8; bytes.split() parts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the one of setCheckpointDir, else a temporary one.

    A temporary folder is local to one machine, so it is refused unless the master is local.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cairnspark.shared.dir", None)
    if not where:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_.get() if set_.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cairnspark-")
        spark.conf.set("cairnspark.shared.dir", where)
    return where


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder (by the values of a column) and read back: lineage is cut, and a lost executor loses nothing.

    The files go when the driver's JVM ends; `forget` drops those that nothing reads any more before that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = _hadoop_path(spark, path)
    fs.deleteOnExit(at)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # the shuffle files of this step go once it is written
    try:
        out = df.write.option("parquet.block.size", ROW_GROUP)  # a writer holds a row group
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame, part: str = "") -> None:
    """Deletes the files of a table that `stored` returned, or those of one value (`column=value`), that no later result reads."""
    fs, at = _hadoop_path(df.sparkSession, f"{df.stored_at}/{part}")
    fs.delete(at, True)


_M_MMAP_THRESHOLD = -3  # fixed value of the C library


def give_back() -> None:
    """Returns a worker's freed memory to the system, and has large arrays returned as soon as they are freed, so that groups do not add up."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(_M_MMAP_THRESHOLD, 1 << 20)
        libc.malloc_trim(0)


def parts_for(spark: SparkSession, size: int = 0, each: int = 1) -> int:
    """Parts to deal `size` out to so that one holds about `each`, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def placed(matches: str, extra: dict[str, str]) -> str:
    """SQL for the spans of an array<struct<pre,hit>>, each match with what lies between it and the one before.

    Gives array<struct<start,end,...>> in code points, with further fields from expressions over `x`, the match. Offsets
    are summed in runs of about the square root of the matches, so a text of n matches takes n ** 1.5 small steps, not n ** 2.
    """
    run = "greatest(16, CAST(ceil(sqrt(size(m))) AS INT))"
    fields = "".join(f", '{k}', {v}" for k, v in extra.items())
    moved = "".join(f", '{k}', x.{k}" for k in extra)
    span = f"named_struct('start', s.at + length(x.pre), 'end', s.at + length(x.pre) + length(x.hit){fields})"
    empty = f"slice(transform(array(named_struct('pre', '', 'hit', '')), x -> named_struct('start', 0, 'end', 0{fields})), 1, 0)"
    one = f"""aggregate(slice(m, CAST(k * {run} AS INT) + 1, {run}), named_struct('at', 0, 'out', {empty}),
      (s, x) -> named_struct('at', s.at + length(x.pre) + length(x.hit), 'out', concat(s.out, array({span}))))"""
    runs = f"transform(sequence(0, (greatest(size(m), 1) - 1) div {run}), k -> {one})"
    starts = "aggregate(r, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (s, x) -> named_struct('at', s.at + x.at, 'out', concat(s.out, array(s.at))), s -> s.out)"
    whole = f"flatten(zip_with(r, {starts}, (c, at) -> transform(c.out, x -> named_struct('start', at + x.start, 'end', at + x.end{moved}))))"
    return f"element_at(transform(transform(array({matches}), m -> {runs}), r -> {whole}), 1)"
