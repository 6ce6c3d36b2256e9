"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Items are the indexed documents, passages the queries. A passage is a window of twice the longest item's words, moved
on by that length, so every item that a text quotes lies whole in one window. An item's impacts are divided by its
score against itself: 1 is a full quotation and one threshold serves all items. Items stand in at most `ITEM_BLOCKS` blocks
of consecutive ids; for each passage and block a numpy sum of the terms' block maxima comes first. Only blocks that can still
reach the threshold are searched by WAND, which skips items by term bounds, then by bounds of posting blocks. Each hit is verified on five-word shingles of the whole item, of its
question (all but the last sentence) and of its answer.

The index is built in shards of about `SHARD_BYTES` of item text, each broadcast only once its size is checked
(`BROADCAST_BYTES`); the number of shards grows with the items. An item of more than `MOST_WORDS` words is indexed by
overlapping parts; where one is found, the item's question and answer are looked up in the whole text. All documents
are read once for each shard, nothing of them is shuffled.

Defined results: null and empty texts hit nothing; items without words are no items; an item, question or answer of fewer than
five words is one shingle of its own length; items may have ids of any type, null too; rows of one item id are one item
each, and a document's best row for an id is returned; repeated documents each give rows; without items nothing is found;
extra columns are ignored (keep_clean keeps them).
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from cairnspark.llm.common import texts

K1, B, BLOCK, ITEM_BLOCKS = 1.2, 0.75, 8, 32
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
SHARD_BYTES, BROADCAST_BYTES, MOST_WORDS = 4_000_000, 512_000_000, 512
WORDS = re.compile(r"[^\W_]+").findall
_NEVER = 1 << 60


def shingles(words: list[str]) -> set[tuple]:
    k = min(SHINGLE, len(words))
    return set(zip(*(words[i:] for i in range(k)))) if k else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; a text of one sentence is parted in its middle."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if WORDS(p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def _rank(hit: tuple) -> tuple:
    """Orders an item's windows: first by what the verification looks at."""
    return max(hit[2], min(hit[3], hit[4])), hit[2:]


class Index:
    """Impact-ordered by item; postings in blocks with their maxima."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.parts, self.long = [], [], [], []
        for item_id, text in items:
            words, asked = WORDS((text or "").lower()), None
            for at in range(0, max(1, len(words) - MOST_WORDS // 2), MOST_WORDS // 2):
                part = words[at : at + MOST_WORDS]
                if part:
                    q, a = asked or question_and_answer(text)
                    asked = q, a
                    self.ids.append(item_id)
                    self.words.append(part)
                    self.parts.append((shingles(part), shingles(WORDS(q.lower())), shingles(WORDS(a.lower()))))
                    self.long.append(len(words) > MOST_WORDS)
        n = len(self.ids)
        mean = sum(map(len, self.words)) / n if n else 1.0
        found: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(self.words):
            for w in dict.fromkeys(words):
                found.setdefault(w, []).append((i, words.count(w)))
        idf = {w: math.log(1 + (n - len(p) + 0.5) / (len(p) + 0.5)) for w, p in found.items()}
        own = [0.0] * n
        raw: dict[str, list[tuple[int, float]]] = {}
        for w, p in found.items():
            raw[w] = [(i, idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.words[i]) / mean))) for i, tf in p]
            for i, s in raw[w]:
                own[i] += s
        self.term = {w: k for k, w in enumerate(raw)}
        self.docs = [[i for i, _ in p] for p in raw.values()]
        self.impacts = [[s / own[i] for i, s in p] for p in raw.values()]
        self.bound = np.array([max(x) for x in self.impacts] + [0.0])
        self.blocks = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        self.step = max(1, -(-n // ITEM_BLOCKS))
        self.block_bound = np.zeros((len(raw) + 1, max(1, -(-n // self.step))), np.float32)
        for t, (docs, x) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.block_bound[t], np.array(docs) // self.step, np.array(x, np.float32))
        self.window = max(map(len, self.words), default=1)

    def search(self, terms: list[int], threshold: float, low: int = 0, high: int = _NEVER) -> list[tuple[int, float]]:
        """All (item, score) of at least the threshold among items low to high - 1: block-max WAND."""
        lists = []  # current item, place in the postings, term
        for t in terms:
            at = bisect_left(self.docs[t], low)
            if at < len(self.docs[t]) and self.docs[t][at] < high:
                lists.append([self.docs[t][at], at, t])
        out = []
        eps = threshold - 1e-9
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                total += self.bound[t]
                if total >= eps:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            limit, ends = 0.0, _NEVER
            for _, at, t in lists[: pivot + 1]:
                docs = self.docs[t]
                at = bisect_left(docs, item, at)
                if at < len(docs):
                    limit += self.blocks[t][at // BLOCK]
                    last = min(len(docs), (at // BLOCK + 1) * BLOCK) - 1
                    ends = min(ends, docs[last] + 1)
            if limit >= eps:
                score = 0.0
                for x in lists[: pivot + 1]:
                    at = bisect_left(self.docs[x[2]], item, x[1])
                    if at < len(self.docs[x[2]]) and self.docs[x[2]][at] == item:
                        score += self.impacts[x[2]][at]
                if score >= eps:
                    out.append((item, score))
                to = item + 1
            else:  # no item before the nearest block end, nor before the next list's item, can reach the threshold
                to = max(item + 1, min(ends, lists[pivot + 1][0] if pivot + 1 < len(lists) else _NEVER))
            kept = []
            for k, x in enumerate(lists):
                if k <= pivot:
                    x[1] = bisect_left(self.docs[x[2]], to, x[1])
                    if x[1] == len(self.docs[x[2]]) or self.docs[x[2]][x[1]] >= high:
                        continue
                    x[0] = self.docs[x[2]][x[1]]
                kept.append(x)
            lists = kept
        return out

    def hits(self, text: str, threshold: float) -> list[tuple[int, float, float, float, float]]:
        """(item id, score, overlap, question overlap, answer overlap): the best window's, for each item retrieved."""
        words = WORDS(text.lower())
        if not words or not self.ids:
            return []
        n, none = len(words), len(self.term)
        ids = np.fromiter((self.term.get(w, none) for w in words), np.int64, n)
        parts = np.add.reduceat(self.block_bound[ids], np.arange(0, n, self.window), axis=0)
        sums = parts[:-1] + parts[1:] if len(parts) > 1 else parts
        best: dict[int, tuple] = {}
        eps = threshold - 1e-3
        everywhere: dict[int, set[tuple]] = {}
        for k in np.flatnonzero((sums >= eps).any(1)):
            s, e = int(k) * self.window, min(n, (int(k) + 2) * self.window)
            terms = np.unique(ids[s:e])
            terms = terms[terms < none]
            blocks = np.flatnonzero(self.block_bound[terms].sum(0) >= eps)
            here: dict[int, set[tuple]] = {}  # the window's shingles by their length
            terms = terms.tolist()
            for i, score in (h for j in blocks.tolist() for h in self.search(terms, threshold, j * self.step, (j + 1) * self.step)):
                over = []
                for k, p in enumerate(self.parts[i]):
                    size = len(next(iter(p))) if p else 0  # a part of fewer than SHINGLE words is one shingle of its own length
                    held, low, high = (everywhere, 0, n) if k and self.long[i] else (here, s, e)
                    if size and size not in held:
                        held[size] = set(zip(*(words[low + j : high] for j in range(size))))
                    over.append(len(p & held[size]) / len(p) if p else 1.0)
                got = (self.ids[i], score, *over)
                key = self.ids[i]
                if key not in best or _rank(got) > _rank(best[key]):
                    best[key] = got
        return list(best.values())


def _indexes(items: DataFrame) -> Iterator[Broadcast]:
    """One broadcast for each shard of the items; shards are bounded by their bytes, so one may be collected."""
    i = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = i.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    i = i.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    for shard in range(shards):
        rows = [(r.item_id, r.text) for r in i.where(F.col("shard") == shard).collect()]
        index = Index(sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])))
        if (weight := len(pickle.dumps(index))) > BROADCAST_BYTES:
            raise ValueError(f"an index shard of {weight} bytes; lower SHARD_BYTES")
        yield items.sparkSession.sparkContext.broadcast(index)


def _verified(index: Index, text: str, threshold: float, overlap: float) -> list[tuple]:
    return [h for h in index.hits(text, threshold) if h[2] >= overlap or min(h[3], h[4]) >= overlap]


def retrieve(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap for each verified quotation of an item."""
    d = texts(docs)
    schema = StructType([StructField("doc_id", d.schema["doc_id"].dataType), StructField("item_id", items.schema["item_id"].dataType)])
    for name in ("score", "overlap", "question_overlap", "answer_overlap"):
        schema = schema.add(name, "double")
    types = pa.schema([pa.field("doc_id", to_arrow_type(schema["doc_id"].dataType)), pa.field("item_id", to_arrow_type(schema["item_id"].dataType))] + [pa.field(n, pa.float64()) for n in schema.names[2:]])
    out = None
    for told in _indexes(items):

        def run(batches, told=told):
            index: Index = told.value  # kept by the worker between tasks
            for b in batches:
                rows = [(k, *h) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in _verified(index, t, threshold, overlap)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)] if rows else [pa.array([], f.type) for f in types], schema=types)

        part = d.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The documents that quote no item, with their columns: judged row by row, so nothing is joined or shuffled."""
    for told in _indexes(items):

        def run(batches, told=told):
            index: Index = told.value  # kept by the worker between tasks
            for b in batches:
                place = b.schema.get_field_index("text")
                yield b.filter(pa.array([not _verified(index, t or "", threshold, overlap) for t in b.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
