"""Suffix-array dedup: bytes covered by a 400-byte string that starts anywhere else are removed, exactly.

Every 400-byte window has one anchor: its 16-byte gram of least hash (of equal ones the last). Equal windows have equal
anchors, so windows are dealt out by anchor: a run of consecutive windows with one anchor travels as one piece of text,
and only if the anchor's hash occurs again somewhere. The pieces of an anchor that occurs more than `MOST_PLACES` times are cut
in two and dealt out further, by the 192 bytes before or after the anchor that their windows share. Equal pieces collapse in
a block, and again within a partition; what is left of anchors with different pieces is merged by interleave refinement. `merge_transforms` is the method as such: the order of all suffixes by
their first h bytes gives, by a stable pass over the merged Burrows-Wheeler transforms of the shards, the order by h + 1; the
step at which two neighbours part is their common prefix. 400 such steps cost about 12 microseconds a byte, so
the query refines with a doubling stride (`repeated_windows`), which the tests hold against the single steps.

Documents are dealt to blocks of bounded bytes; nothing is collected on the driver. Copies in a block are collapsed before
the shuffle. Defined results: null and empty texts have no bytes and the hash of nothing; a text shorter than 400
bytes loses nothing; repeated rows are repeats of each other; an empty table gives no rows; columns besides doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.common import give_back, parts_for, texts

LENGTH, GRAM = 400, 16
BLOCK_BYTES = 4_000_000
PART_BYTES = 4_000_000
MERGE_BYTES = 1_000_000
MOST_PLACES, BESIDE = 2_000, 192
_STRETCH = 1 << 20  # windows looked at together; bounds the arrays of a very long text
_PLACE = np.uint64((1 << 28) - 1)
_OUT = 0xFF  # no byte of UTF-8: stands between pieces


def anchor_runs(b: np.ndarray, length: int = LENGTH, stretch: int = _STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: anchor hash, first window start, last window start.

    A run also ends where a stretch of windows does; its parts have one anchor and meet again when anchors are judged.
    """
    found = [(h, first + at, last + at) for at in range(0, len(b) - length + 1, stretch) for h, first, last in [_runs_of_stretch(b[at : at + stretch + length - 1], length)]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    eight = np.lib.stride_tricks.sliding_window_view(b, 8).copy().view("<u8").ravel()
    h = eight[: len(b) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h + eight[8:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _runs_of_stretch(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b)
    h = gram_hashes(b)
    key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last is least
    w = length - GRAM + 1
    rows = -(-len(h) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    place = (_PLACE - (least & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    return h[place[first]], first, last


def transform(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform of the pieces of one shard, each closed by `_OUT`."""
    t = np.frombuffer(b"".join(p + bytes([_OUT]) for p in pieces), np.uint8)
    n = len(t)
    rank, h = t.astype(np.int64), 1
    while h < 2 * n:
        found, rank = np.unique(rank * (n + 257) + np.roll(rank, -h), return_inverse=True)
        if len(found) == n:
            break
        h *= 2
    order = np.argsort(rank, kind="stable")
    return order, t[order - 1]


def merge_transforms(transforms: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each rank, common prefix with the rank before): interleave refinement of several transforms, `length` steps.

    The common prefix is exact below `length`, and `length` stands for that and more.
    """
    joined = np.concatenate(transforms)
    n = len(joined)
    shard = np.repeat(np.arange(len(transforms)), [len(x) for x in transforms]).astype(np.uint8 if len(transforms) <= 256 else np.uint16)
    common = np.full(n, length, np.int16)
    block = np.zeros(n, np.int32)  # ranks that agree on all steps so far share a block
    symbol = np.empty(n, np.uint8)
    starts = np.zeros(n, bool)
    for step in range(length):
        symbol[np.argsort(shard, kind="stable")] = joined
        to = np.argsort(symbol, kind="stable")
        shard, moved, symbol_sorted = shard[to], block[to], symbol[to]
        starts[0] = True
        np.logical_or(symbol_sorted[1:] != symbol_sorted[:-1], moved[1:] != moved[:-1], out=starts[1:])
        common[starts & (common == length)] = step
        block = np.cumsum(starts, dtype=np.int32)
        if block[-1] == n:
            break
    return shard, common


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of different pieces, whether the window at each start occurs again in these pieces.

    The refinement of `merge_transforms` with a stride: suffixes that agree on `depth` bytes and, moved on by the stride,
    on `depth` bytes again, agree on their sum. The stride doubles, so 400 bytes take 7 passes; what is alone in its
    class is settled and leaves the passes.
    """
    t = np.frombuffer(b"".join(p + bytes([_OUT]) for p in pieces) + bytes([_OUT]) * 8, np.uint8)
    n, depth = len(t) - 8, min(8, length)
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key <<= np.uint64(8)
        key |= t[i : i + n]
    live = np.argsort(key, kind="stable").astype(np.int32)
    key = key[live]
    cls = np.zeros(n + length, np.int32)  # beyond the end: a class of its own
    while True:
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(starts)
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        # a class is named by a place that its first member alone can give: names stay unique as classes split
        cls[live] = np.repeat(live[first], sizes) + 1
        live = live[np.repeat(sizes, sizes) > 1]
        if depth >= length or not len(live):
            break
        stride = min(depth, length - depth)
        key = cls[live] * np.int64(n + 1)
        key += cls[live + stride]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        depth += stride
    repeated = np.zeros(n, bool)
    repeated[live] = True
    out, at = [], 0
    for p in pieces:
        out.append(repeated[at : at + len(p) - length + 1])
        at += len(p) + 1
    return out


def _runs_of(pdf: pd.DataFrame, length: int) -> Iterator[tuple]:
    for k, text in zip(pdf.k, pdf.text):
        raw = text.encode("utf-8", "surrogatepass")
        yield (k, raw, *anchor_runs(np.frombuffer(raw, np.uint8), length))


def _asks(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        found = [h for _, _, h, _, _ in _runs_of(pdf, length)]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return pd.DataFrame({"anchor": h.astype(np.int64), "block": pdf.block.iloc[0], "n": n})

    return run


def _name(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def halves(anchor: int, piece: bytes, length: int = LENGTH, beside: int = BESIDE) -> list[tuple[int, int, bytes]]:
    """(new anchor, where it begins, bytes) of the parts of a piece: windows that begin `beside` or more before the anchor, and the others.

    Windows of a part share the bytes that its new anchor is made of, so equal windows still have equal anchors.
    """
    h = gram_hashes(np.frombuffer(piece, np.uint8)[:length])
    at = int(np.flatnonzero((h & ~_PLACE) == (np.uint64(anchor % (1 << 64)) & ~_PLACE))[-1])  # the last of equals in the first window
    last, cut = len(piece) - length, at - beside
    out = []
    if cut >= 0:
        out.append((_name(b"<%d" % anchor + piece[cut : at + GRAM]), 0, piece[: min(last, cut) + length]))
    if last > cut:
        low = max(0, cut + 1)
        out.append((_name(b">%d" % anchor + piece[at : at + GRAM + beside]), low, piece[low:]))
    return out


def _pieces(length: int):
    def run(pdf: pd.DataFrame, again: pd.DataFrame) -> pd.DataFrame:
        give_back()
        order = np.argsort(again.anchor.to_numpy(np.int64).astype(np.uint64))
        wanted, hot = again.anchor.to_numpy(np.int64).astype(np.uint64)[order], again.hot.to_numpy(bool)[order]
        held: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        if len(wanted) and len(pdf):
            for k, raw, h, first, last in _runs_of(pdf, length):
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                for i in np.flatnonzero(wanted[at] == h).tolist():
                    anchor, piece, start = int(np.int64(h[i].astype(np.int64))), raw[first[i] : last[i] + length], int(first[i])
                    parts = halves(anchor, piece, length) if hot[at[i]] and length > 2 * BESIDE + GRAM else [(anchor, 0, piece)]
                    for new, low, part in parts:
                        held.setdefault((new, part), []).append((k, start + low))
        rows = [(a, p, np.array(o, np.int64).tobytes()) for (a, p), o in held.items()]
        out = pd.DataFrame(rows, columns=["anchor", "piece", "places"])
        out["block"] = pdf.block.iloc[0] if len(pdf) else 0
        return out

    return run


def _judge(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        count: dict[bytes, int] = {}
        of: dict[int, dict[bytes, None]] = {}
        for a, p, o in zip(pdf.anchor, pdf.piece, pdf.places):
            count[p] = count.get(p, 0) + len(o) // 16
            of.setdefault(a, {})[p] = None
        flags: dict[bytes, np.ndarray] = {}
        todo: list[bytes] = []

        def settle():
            flags.update(zip(todo, repeated_windows(todo, length)))
            todo.clear()

        size = 0
        for different in of.values():
            if len(different) > 1:
                todo.extend(different)
                size += sum(map(len, different))
                if size > MERGE_BYTES:
                    settle()
                    size = 0
        if todo:
            settle()
        rows = []
        for p, block, o in zip(pdf.piece, pdf.block, pdf.places):
            if count[p] > 1:
                spans = [(0, len(p))]
            elif p in flags:
                f = np.flatnonzero(np.diff(np.concatenate([[0], flags[p].view(np.int8), [0]])))
                spans = [(int(s), int(e) - 1 + length) for s, e in zip(f[::2], f[1::2])]
            else:
                continue
            for k, start in np.frombuffer(o, np.int64).reshape(-1, 2).tolist():
                rows += [(block, k, start + s, start + e) for s, e in spans]
        return pd.DataFrame(rows, columns=["block", "k", "s", "e"])

    return run


def _cut(pdf: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    give_back()
    by: dict[int, list[tuple[int, int]]] = {}
    for k, s, e in zip(spans.k, spans.s, spans.e):
        by.setdefault(k, []).append((s, e))
    rows = []
    for k, text in zip(pdf.k, pdf.text):
        raw = text.encode("utf-8", "surrogatepass")
        merged: list[list[int]] = []
        for s, e in sorted(by.get(k, ())):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        starts, ends = [s for s, _ in merged], [e for _, e in merged]
        kept = b"".join(raw[a:z] for a, z in zip([0, *ends], [*starts, len(raw)])) if merged else raw
        rows.append((len(raw), starts, ends, kept))
    out = pd.DataFrame(rows, columns=["n_bytes", "start", "end", "kept"])
    out.insert(0, "doc_id", pdf.doc_id.values)
    return out


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each removed run, in bytes), kept (the other bytes; a run may end inside a character)."""
    d = texts(docs)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-size // BLOCK_BYTES)), max(parts_for(docs.sparkSession), -(-size // PART_BYTES))
    x = d.withColumn("k", F.xxhash64("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block", F.pmod("k", F.lit(blocks)).cast("int"))
    asks = x.groupBy("block").applyInPandas(_asks(length), "anchor long, block int, n long")
    # an anchor has at most one row for each block
    again = asks.withColumn("all", F.sum("n").over(Window.partitionBy("anchor"))).where("all > 1").select("block", "anchor", (F.col("all") > MOST_PLACES).alias("hot"))
    pieces = x.groupBy("block").cogroup(again.groupBy("block")).applyInPandas(_pieces(length), "anchor long, piece binary, places binary, block int")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)))
    spans = pieces.groupBy("part").applyInPandas(_judge(length), "block int, k long, s long, e long")
    out = x.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(_cut, "doc_id string, n_bytes long, start array<long>, end array<long>, kept binary")
    return out.select(F.col("doc_id").cast(d.schema["doc_id"].dataType), "n_bytes", F.arrays_zip("start", "end").alias("spans"), "kept")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document, from what `cut_repeats` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut_repeats(docs, length).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
