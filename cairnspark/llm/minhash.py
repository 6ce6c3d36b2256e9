"""Document fingerprints: MinHash signatures in vectorised numpy, banded in Spark, Jaccard verified.

A text's shingles are its runs of five words (fewer words: the whole sequence). A shingle's 64-bit value combines the
hashes of its words; `PERMUTATIONS` multiply-add universal hashes give one minimum each, of which 16 bits are kept.
Signatures of equal texts are equal. Near duplicates share one of `BANDS` bands: signatures that meet in a band are compared,
which gives candidate classes; within these the shingle sets decide, each sent once for every slice of its candidate class.

Defined results: null and empty texts, and texts of white space, have no shingle and the all-ones signature, alike to
each other only; repeated rows repeat; columns besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.common import mapped, parts_for, stored, texts, words_of
from cairnspark.llm.components import components
from cairnspark.sources.shared import small_batches

PERMUTATIONS, BANDS, SHINGLE = 128, 32, 5
SIMILAR, MARGIN = 0.8, 0.25
MOST_IN_TREE, MOST_SHINGLES, SHARD_ROWS = 4096, 2_000_000, 25_000
RANGE_BYTES = 64_000_000
_RANDOM = np.random.default_rng(20_011)
_A = (_RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MOST_WORDS = 400_000


class Shingler:
    """64-bit shingle values of texts; hashes of words are kept up to a bound."""

    def __init__(self):
        self.hashes: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.hashes
        if len(known) > _MOST_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(SHINGLE, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + len(out)]) * _MIX[i]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima, 16 bits of each."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024]
        np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(1), out=low)
    # the minima of many shingles are small numbers: what is kept is mixed from all their bits
    mixed = (low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(low == np.iinfo(np.uint64).max, 0xFFFF, mixed >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity from two signatures; chance agreement of 16 bits is 1 in 65,536."""
    return float((a == b).mean())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), for each document."""
    d = texts(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "fingerprint": [signature(shingle(t)).tobytes().hex() for t in b.text]})

    return mapped(d, run, "fingerprint string")


class Classes:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


def _alike(sig: np.ndarray, members: np.ndarray, queries: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Pairs (query, member) whose signatures agree in at least `least` places."""
    for q in queries.tolist():
        for at in range(0, len(members), 4096):
            part = members[at : at + 4096]
            for m in part[(sig[part] == sig[q]).sum(1) >= least].tolist():
                if m != q:
                    yield q, m


def _linked(similar: float, verify: bool):
    """Links that connect what the pairs of each group connect, at most one for each set but the first.

    A group's members meet its queries. A pair is linked if its signatures lie no more than MARGIN below `similar` and,
    with `verify`, the Jaccard similarity of the shingle sets reaches `similar`; pairs already in one class are passed over.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, x in pdf.groupby("g", sort=False):
            sig = np.stack([np.frombuffer(bytes.fromhex(f), ">u2") for f in x.fingerprint])
            same, sets = x.same.tolist(), x.shingles.tolist() if verify else None
            classes = Classes(len(same))
            for q, m in _alike(sig, np.flatnonzero(x.member.to_numpy(bool)), np.flatnonzero(x.asks.to_numpy(bool)), (similar - MARGIN) * PERMUTATIONS):
                if classes.top(q) == classes.top(m):
                    continue
                j = 1.0
                if verify:
                    both = len(np.intersect1d(sets[q], sets[m], assume_unique=True))
                    total = len(sets[q]) + len(sets[m]) - both
                    j = both / total if total else 1.0
                    if j < similar:
                        continue
                classes.join(q, m)
                rows.append((min(same[q], same[m]), max(same[q], same[m]), j))
        return pd.DataFrame(rows, columns=["a", "b", "jaccard"])

    return run


def _sliced(routed: DataFrame, key: str) -> DataFrame:
    """routed (same, key, slices) dealt to groups g of a pair of slices: all of the one are members, all of the other ask."""
    r = routed.withColumn("own", F.pmod(F.xxhash64("same"), "slices").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return r.select("same", F.xxhash64(key, low, high).alias("g"), (F.col("own") == low).alias("member"), (F.col("own") == high).alias("asks"))


def _distinct_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same) for each document, and (same, rep, fingerprint, shingles) for each different shingle set."""
    d = texts(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for b in batches:
            sets = [shingle(t) for t in b.text]
            yield pd.DataFrame({
                "doc_id": b.doc_id,
                "fingerprint": [signature(s).tobytes().hex() for s in sets],
                "same": [hashlib.sha256(s.tobytes()).hexdigest() for s in sets],
                "shingles": [s.astype(np.int64) for s in sets],
            })

    with small_batches(docs.sparkSession):
        s = stored(mapped(d, run, "fingerprint string, same string, shingles array<long>"), "minhash")
    sets = s.groupBy("same").agg(F.min("doc_id").alias("rep"), F.any_value("fingerprint").alias("fingerprint"), F.any_value("shingles").alias("shingles"))
    sets = sets.withColumn("n", F.size("shingles"))
    return s.select("doc_id", "same"), stored(sets, "minhash-sets")


def _links(sets: DataFrame, similar: float, most: int) -> DataFrame:
    """(a, b, jaccard) between different shingle sets, keyed by `same`; see near_duplicates."""
    spark, width = sets.sparkSession, PERMUTATIONS // BANDS * 4
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(fingerprint, i * {width} + 1, {width})))")
    bands = sets.select("same", F.explode(band).alias("band"))
    shared = bands.groupBy("band").count().where("count > 1").select("band", "count", F.ceil(F.col("count") / most).cast("int").alias("slices"))
    shared = stored(shared, "minhash-bands")
    # a worker holds a shard: they are as many as what is dealt out asks for, copies for other slices included
    rows = shared.agg(F.sum(F.col("count") * F.col("slices"))).first()[0] or 0
    met = _sliced(bands.join(shared.drop("count"), "band"), "band").join(sets.select("same", "fingerprint"), "same")
    shards = parts_for(spark, rows, SHARD_ROWS)
    schema = "a string, b string, jaccard double"
    likely = met.withColumn("shard", F.pmod("g", F.lit(shards))).groupBy("shard").applyInPandas(_linked(similar, False), schema)
    found = stored(components(likely.select("a", "b")).join(sets.select(F.col("same").alias("node"), "n"), "node"), "minhash-candidates")
    of = found.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("n"))
    of = of.select("root", "n", F.ceil(F.greatest(F.col("sets") / most, F.col("n") / MOST_SHINGLES)).cast("int").alias("slices"))
    weight = of.agg(F.sum(F.col("n") * F.col("slices"))).first()[0] or 0
    of = of.drop("n")
    full = _sliced(found.select(F.col("node").alias("same"), "root").join(of, "root"), "root").join(sets.select("same", "fingerprint", "shingles"), "same")
    full = full.withColumn("shard", F.pmod("g", F.lit(parts_for(spark, weight, MOST_SHINGLES))))
    links = full.groupBy("shard").applyInPandas(_linked(similar, True), schema)
    return links.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, most: int = MOST_IN_TREE) -> DataFrame:
    """(rep_a, rep_b, jaccard) between representatives of different texts with Jaccard similarity of `similar` or more.

    Equal shingle sets collapse first; the smallest doc_id stands for them (null where no copy has an id). In a band
    bucket every signature meets every other; those that lie no more than MARGIN below `similar` (seven standard
    deviations) make candidate classes, in which every two sets meet again and are verified by Jaccard unless links
    already found put both in one class. Buckets and classes of more than `most` sets are dealt to slices, and each pair
    of slices is a group of its own. The links thus connect all that any verified pair connects, without listing every
    pair of a class; near_classes has the membership.
    """
    _, sets = _distinct_sets(docs)
    e = _links(sets, similar, most)
    a, b = sets.select(F.col("same").alias("a"), F.col("rep").alias("ra")), sets.select(F.col("same").alias("b"), F.col("rep").alias("rb"))
    return e.join(a, "a").join(b, "b").select(F.expr("IF(ra IS NULL OR rb < ra, rb, ra)").alias("rep_a"), F.expr("IF(ra IS NULL OR rb < ra, ra, rb)").alias("rep_b"), "jaccard")


def near_classes(docs: DataFrame, similar: float = SIMILAR, most: int = MOST_IN_TREE) -> DataFrame:
    """(doc_id, class_id) for each document: class_id is the smallest doc_id reachable over verified links."""
    rows, sets = _distinct_sets(docs)
    linked = components(_links(sets, similar, most)).withColumnRenamed("node", "same")
    found = sets.select("same", "rep").join(linked, "same", "left").withColumn("root", F.coalesce("root", "same"))
    low = found.groupBy("root").agg(F.min("rep").alias("class_id"))
    return rows.join(found.select("same", "root").join(low, "root").select("same", "class_id"), "same").select("doc_id", "class_id")


def _range_tops(d: DataFrame, ranges: int) -> list:
    """The largest doc_id of each of about `ranges` ranges of doc_id, descending; one value for each, whatever the documents."""
    ids = d.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(ranges, F.desc("doc_id"))
    tops = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top"))
    return sorted({r.top for r in tops.collect()}, reverse=True)


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text, next_text): the next document by descending doc_id, ties by text, null ids last, the first after the last.

    Documents go to ranges of doc_id, of any type that sorts, that begin at a document; each range also gets a copy of the
    documents that begin the next one, so the window within a range needs no other and each text moves once. Only ids are
    looked at to place the ranges; their tops, one for each `range_bytes` of text, are sent to the tasks.
    """
    d = texts(docs)
    spark, kind = docs.sparkSession, d.schema["doc_id"].dataType.simpleString()
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tops = _range_tops(d, parts_for(spark, size, range_bytes))
    last, steps = max(0, len(tops) - 1), max(1, len(tops).bit_length())
    # one constant array, searched by halving: the last top that is at least the id
    keyed = d.withColumn("tops", F.from_json(F.lit(json.dumps(tops, default=str)), f"array<{kind}>"))
    found = f"""aggregate(sequence(1, {steps}), named_struct('low', 0, 'high', {last}), (s, i) -> IF(s.low >= s.high, s,
        IF(tops[CAST((s.low + s.high + 1) div 2 AS INT)] >= doc_id, named_struct('low', CAST((s.low + s.high + 1) div 2 AS INT), 'high', s.high),
           named_struct('low', s.low, 'high', CAST((s.low + s.high + 1) div 2 AS INT) - 1))), s -> s.low)"""
    keyed = keyed.withColumn("range", F.expr(f"IF(doc_id IS NULL, {last}, {found})"))
    keyed = keyed.withColumn("at", F.expr("named_struct('range', range, 'is_top', doc_id IS NOT NULL AND tops[range] = doc_id)")).drop("tops", "range")
    keyed = keyed.withColumn("to", F.expr(f"""filter(array(
        named_struct('range', at.range, 'copy', 0),
        IF(at.is_top AND at.range > 0, named_struct('range', at.range - 1, 'copy', 1), NULL),
        IF({'at.is_top AND at.range = 0' if tops else 'true'}, named_struct('range', {last}, 'copy', 2), NULL)), x -> x IS NOT NULL)"""))  # fmt: skip
    keyed = keyed.select("doc_id", "text", F.explode("to").alias("to")).select("doc_id", "text", "to.range", "to.copy")
    w = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    out = keyed.withColumn("next_text", F.lead("text").over(w)).where("copy = 0")
    return out.select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document."""
    d = with_next(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for b in batches:
            rows, kept = [], None
            for text, after in zip(b.text, b.next_text):
                half = len(text) // 2
                edited = text[: len(text) - half] + after[:half]
                own = kept[1] if kept and kept[0] == text else signature(shingle(text))
                new = signature(shingle(edited))
                nxt = signature(shingle(after))
                kept = after, nxt  # rows follow each other: the next row's own text is mostly this one
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(text), sha, own.tobytes().hex(), new.tobytes().hex(), likeness(own, new), likeness(own, nxt)))
            out = pd.DataFrame(rows, columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            out.insert(0, "doc_id", b.doc_id.values)
            yield out

    return mapped(d, run, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
