"""SimHash near-dedup: fingerprints linked through BK-trees, exactly, whatever their number.

Texts collapse to distinct fingerprints first, so copies cost one row. Two fingerprints that differ in at most
three bits agree in one of four 16-bit blocks; each fingerprint goes to the shards of its four block values. A shard
holds one BK-tree per block value: children hang at their Hamming distance to the parent, and a search follows only
edges within the radius of the node's distance. Trees are built and searched level by level in numpy. A block value
with more than `MOST_IN_TREE` fingerprints is dealt to several trees, and its queries to as many slices: each pair of a tree
and a slice is one group, so no group holds more than about twice `MOST_IN_TREE`, however common the value. Shard
trees travel to the tasks through the shuffle rather than as one broadcast, since all trees together grow with the data;
the number of shards grows with the fingerprints.
A group emits one link per fingerprint and component of its own; components are then joined across groups.

Defined results: null and empty texts, and texts of white space, have fingerprint zero, linked like any other;
repeated rows repeat; an empty table gives no rows; columns besides doc_id and text are ignored (dedup keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.common import mapped, parts_for, stored, texts, words_of
from cairnspark.llm.components import components

RADIUS, BLOCKS, SHINGLE, SEED = 3, 4, 3, 42
MOST_IN_TREE = 8192
SHARD_ROWS = 200_000
_FRONTIER = 1_000_000


def fingerprint(text: str) -> int:
    """Bit i is set if it is set in over half of the XXH64 values (seed 42) of the 3-word shingles, repeats counted."""
    words = words_of(text)
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    n = len(words) - k + 1
    for at in range(0, n, 50_000):
        part = words[at : at + 50_000 + k - 1]
        sh = [b" ".join(x) for x in zip(*(part[i:] for i in range(k)))]
        raw = b"".join([digest(s, SEED) for s in sh])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    d = texts(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.text], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id, "fp": fp})

    return mapped(d, run, "fp long")


class Forest:
    """BK-trees, one per group, over distinct 64-bit values; `group` must be sorted."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        n = len(value)
        first = np.ones(n, bool)
        first[1:] = group[1:] != group[:-1]
        self.roots = np.flatnonzero(first)
        self.root_groups = group[self.roots]
        node = self.roots[np.cumsum(first) - 1] if n else np.zeros(0, int)
        rest = np.flatnonzero(~first)
        keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rest):
            at = node[rest]
            key = at * 65 + np.bitwise_count(value[rest] ^ value[at]).astype(np.int64)
            unique, index, back = np.unique(key, return_index=True, return_inverse=True)
            child = rest[index]  # the first to arrive at this distance becomes the child, the others go on below it
            keys.append(unique)
            kids.append(child)
            node[rest] = child[back]
            rest = np.delete(rest, index)
        self.keys, self.kids = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.kids = self.keys[order], self.kids[order]

    def search(self, group: np.ndarray, value: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, level by level; queries look into the tree of their group."""
        place = np.searchsorted(self.root_groups, group)
        place = np.minimum(place, max(0, len(self.root_groups) - 1))
        has = (self.root_groups[place] == group) if len(self.root_groups) else np.zeros(len(group), bool)
        stack = [(np.flatnonzero(has), self.roots[place[has]] if len(self.roots) else np.zeros(0, int))]
        while stack:
            q, node = stack.pop()
            if len(q) > _FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(value[q] ^ self.value[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
            total = int(count.sum())
            if total:
                start = np.cumsum(count) - count
                kid = self.kids[np.repeat(low - start, count) + np.arange(total)]
                stack.append((np.repeat(q, count), kid))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] for all i; label points to the smallest member in the end."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        m = np.minimum(la, lb)
        np.minimum.at(label, la, m)
        np.minimum.at(label, lb, m)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt


def shard_links(group: np.ndarray, value: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smaller value) that connect what the groups of one shard connect, at most one per value and group."""
    order = np.lexsort((value, group))
    group, value, in_tree, asks = group[order], value[order], in_tree[order], asks[order]
    label = np.arange(len(value))
    members, queries = np.flatnonzero(in_tree), np.flatnonzero(asks)
    forest = Forest(group[members], value[members])
    for q, node in forest.search(group[queries], value[queries], radius):
        merge_labels(label, queries[q], members[node])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return value[linked], value[label[linked]]


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, most: int = MOST_IN_TREE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` whose components are those of all pairs within the radius.

    With `BLOCKS` = radius + 1 blocks the search is exact: of a block value dealt to trees 0 to t - 1, the group of tree i
    and slice j (i <= j) compares all of i with all of j, so every pair meets in one group.
    """
    width = 64 // (radius + 1)
    blocks = F.explode(F.expr(f"transform(sequence(0, {radius}), i -> (shiftrightunsigned(fp, i * {width}) & {(1 << width) - 1}L) * {radius + 1}L + i)"))
    routed = fps.select("fp", blocks.alias("block"))
    large = routed.groupBy("block").count().where(F.col("count") > most).select("block", F.ceil(F.col("count") / most).cast("int").alias("trees"))
    routed = routed.join(large, "block", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    routed = routed.select("fp", "block", F.pmod(F.xxhash64("fp"), "trees").cast("int").alias("own"), F.explode(F.expr("sequence(0, trees - 1)")).alias("other"))
    shards = parts_for(fps.sparkSession, (radius + 1) * fps.count(), SHARD_ROWS)
    tree, slice_ = F.least("own", "other"), F.greatest("own", "other")
    routed = routed.select("fp", F.xxhash64("block", tree, slice_).alias("g"), (F.col("own") == tree).alias("in_tree"), (F.col("own") == slice_).alias("asks"))
    routed = routed.withColumn("shard", F.pmod("g", F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf.g.to_numpy(), pdf.fp.to_numpy().astype(np.uint64), pdf.in_tree.to_numpy(), pdf.asks.to_numpy(), radius)
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return routed.groupBy("shard").applyInPandas(run, "a long, b long")


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for each document."""
    fps = stored(fingerprints(docs), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    linked = components(link_fingerprints(distinct, radius)).withColumnRenamed("node", "fp")
    reps = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = reps.select("fp", "root").join(low, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) for each row: h is the hash of its text, so that doc_id and h tell apart rows of different texts."""
    d = texts(docs).withColumn("h", F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "h", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null is the largest), then of the smallest hash of its text.

    The decision is taken on ids, hashes and fingerprints; texts are shuffled once, to meet it.
    """
    keyed = stored(_keyed(docs), "simhash-keyed")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    distinct = stored(keyed.groupBy("fp").agg(F.min(key).alias("low")), "simhash-distinct")
    linked = components(link_fingerprints(distinct, radius)).withColumnRenamed("node", "fp")
    reps = distinct.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("low").alias("low"))
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("doc_id").isNull().alias("__none")]
    keep = reps.select("low.doc_id", "low.h").select(*own, F.col("h").alias("__hash"))
    by = ["__id", "__none", "__hash"]
    rows = docs.select("*", *own, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash")).join(keep, by, "left_semi")
    one = F.row_number().over(Window.partitionBy(*by).orderBy("__hash"))  # repeated rows: the join's partitioning serves
    return rows.withColumn("__n", one).where("__n = 1").select(*docs.columns)
