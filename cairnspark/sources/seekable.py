"""Zstd streams in independent frames with a table of their lengths at the end, so that a range is read without the rest."""

from __future__ import annotations

import struct

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from cairnspark.sources.shared import keep_batches_small

#: Fixed values of the public seekable format: the table's skippable frame, its footer, the flag of entries with checksums.
SKIPPABLE, MAGIC, FOOTER, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 9, 0x80
FRAMES = ArrayType(StructType([StructField("frame", IntegerType())] + [StructField(n, LongType()) for n in ("c_off", "c_len", "d_off", "d_len")]))


def compress(data: bytes, frame_size: int = 8 << 20, level: int = 9) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level).compress
    raw = [data[i : i + frame_size] for i in range(0, len(data), frame_size)] or [b""]
    frames = [squeeze(x) for x in raw]
    table = b"".join(struct.pack("<II", len(f), len(x)) for f, x in zip(frames, raw)) + struct.pack("<IBI", len(frames), 0, MAGIC)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def table_of(stream: bytes) -> list[tuple[int, int, int, int, int]]:
    """(frame, c_off, c_len, d_off, d_len) of each frame; ValueError where the table is damaged or does not fit the stream."""
    if len(stream) < 8 + FOOTER:
        raise ValueError("seekable stream too short")
    n, flags, magic = struct.unpack("<IBI", stream[-FOOTER:])
    if magic != MAGIC:
        raise ValueError("missing seek table")
    width = 12 if flags & CHECKSUMS else 8
    body = n * width + FOOTER
    if 8 + body > len(stream):
        raise ValueError("seek table larger than stream")
    head = len(stream) - body - 8
    if struct.unpack("<II", stream[head : head + 8]) != (SKIPPABLE, body):
        raise ValueError("bad seek table header")
    out, c_at, d_at = [], 0, 0
    for i in range(n):
        c_len, d_len = struct.unpack_from("<II", stream, head + 8 + i * width)
        out.append((i, c_at, c_len, d_at, d_len))
        c_at, d_at = c_at + c_len, d_at + d_len
    if c_at != head:
        raise ValueError("seek table does not match stream length")
    return out


def read(stream: bytes, start: int, size: int) -> bytes:
    """Bytes start to start + size of the raw data; only the frames that hold them are decompressed."""
    if size <= 0:
        return b""
    loose, out = zstandard.ZstdDecompressor().decompress, []
    for _, c_at, c_len, d_at, d_len in table_of(stream):
        if d_at < start + size and d_at + d_len > start:
            raw = loose(stream[c_at : c_at + c_len], max_output_size=max(d_len, 1))
            out.append(raw[max(0, start - d_at) : start + size - d_at])
    return b"".join(out)


def compressed(data: Column, frame_size: int = 8 << 20, level: int = 9) -> Column:
    """Streams of contents. This, seek_table and read_range keep the session's batches small: contents go to Python and back."""
    keep_batches_small(SparkSession.active())

    @pandas_udf(BinaryType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else compress(bytes(b), frame_size, level))

    return run(data)


@pandas_udf(FRAMES)
def _seek_table(stream: pd.Series) -> pd.Series:
    def one(b):
        try:
            return [dict(zip(("frame", "c_off", "c_len", "d_off", "d_len"), x)) for x in table_of(bytes(b))]
        except (ValueError, TypeError):
            return None

    return stream.map(one)


def seek_table(stream: Column) -> Column:
    """The frames of a stream, null where it has no sound table."""
    keep_batches_small(SparkSession.active())
    return _seek_table(stream)


@pandas_udf(BinaryType())
def _read_range(stream: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else read(bytes(b), int(s), int(n)) for b, s, n in zip(stream, start, size)])


def read_range(stream: str | Column, start: Column, size: Column) -> Column:
    """Bytes of the raw data of each stream; null where that is null."""
    keep_batches_small(SparkSession.active())
    return _read_range(stream, start, size)


def frames(streams: DataFrame, stream: str = "stream", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row for each frame of each stream."""
    return streams.select(*keys, F.explode(seek_table(F.col(stream))).alias("f")).select(*keys, "f.*")
