"""LM scoring by a probabilistic suffix tree over words.

Symbols are words and one end per text. The root's distribution is add-one over all training words. A context (one to
`DEPTH` words) is a candidate if it occurs `LEAST_COUNT` times in training, as is an explicit next symbol, whatever the corpus's
size. A context is retained if the log-likelihood gain of its distribution over its suffix's is at least `GAIN` nats and
`DIVERGENCE` nats a symbol (contexts of retained suffixes only). The probability of a word in its longest retained suffix
state is the explicit count, smoothed Witten-Bell fashion with the next shorter state's probability, down to the root.

Nothing of the model is held in any one place. Texts are read once and encoded in blocks of bounded bytes; a block asks the
parts of a table of gram counts for its distinct words and word pairs, packed as sorted 64-bit hashes, and gets packed counts
back, with a short number for each frequent pair. Longer grams are the numbers of their pairs, and are asked for only where
every pair in them is frequent, so the many rare ones never travel. Of the blocks that hold a frequent pair one owns it and
reports it once; longer frequent grams are reported by the part that counted them. Divergence tests are joins and sums by
context over these. Each block is then sent the retained states of its contexts, in the order in which it asked.
Blocks and parts both grow with the bytes of the corpus, so what one task holds does not; a block sends a part one row, and
none where it has no gram of that part, so the rows never outnumber the grams asked for.

Words are told apart by 64-bit hashes (two of a billion words agree with a chance of about 3 %), longer grams by 56 bits (of ten
billion different ones about seven hundred pairs agree, and count together).
Defined results: null and empty texts are one end; repeated rows count and are scored each; an empty table gives no rows;
with no training rows N and V are 0 and every token has probability 1; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import forget, give_back, held_out, parts_for, stored, texts, words_of

LEAST_COUNT, DEPTH = 8, 3
GAIN, DIVERGENCE = 20.0, 0.01
BLOCK_BYTES = 8_000_000
PART_BYTES = 32_000_000  # text whose grams one part of the table answers for
GRAM_BITS = np.uint64(0xFFFFFFFFFFFFFF00)  # of the hash of a gram of several words, 56 bits tell it apart
END = 0  # the hash that stands for a text's end


def symbols(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts' words with an END (number 0) after each text, symbols in each text, and each number's hash."""
    number: dict[bytes, int] = {}
    parts, sizes = [], []
    for text in batch:
        words = words_of(text)
        for w in words:
            if w not in number:
                number[w] = len(number) + 1
        ids = np.zeros(len(words) + 1, np.int64)
        ids[:-1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        parts.append(ids)
        sizes.append(len(ids))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) or 1 for w in number), np.uint64, len(number))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(sizes, np.int64), np.concatenate([np.array([END], np.uint64), hashes])


def _thin(a: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, squeezed: planes of small numbers vanish."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _thick(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _thin_keys(keys: np.ndarray) -> bytes:
    """Numbers in runs of rising order as steps from one to the next."""
    return _thin(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)))


def _thick_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_thick(raw, np.uint64), dtype=np.uint64)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the grams a followed by the words b."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each block of about BLOCK_BYTES of a partition's texts: word numbers, their hashes, and sizes of the texts."""
    give_back()
    part, made = TaskContext.get().partitionId(), 0
    held: list[pd.DataFrame] = []
    weight = 0

    def flush() -> pd.DataFrame:
        x = pd.concat(held, ignore_index=True)
        ids, sizes, hashes = symbols(x.text.tolist())
        return pd.DataFrame({
            "block": [part * (1 << 20) + made], "doc_ids": [x.doc_id.tolist()], "train": [np.packbits(x.train.to_numpy(bool)).tobytes()],
            "sizes": [_thin(sizes)], "ids": [_thin(ids.astype(np.int32))], "hashes": [hashes.tobytes()], "n_bytes": [weight],
        })

    for b in batches:
        size = b.text.str.len().to_numpy(np.int64)
        cuts = [0]
        for i in np.flatnonzero(np.diff((weight + np.cumsum(size)) // BLOCK_BYTES, prepend=weight // BLOCK_BYTES)).tolist():
            cuts.append(i + 1)
        for low, high in zip(cuts, [*cuts[1:], len(b)]):
            if high > low:
                held.append(b.iloc[low:high])
                weight += int(size[low:high].sum())
            if held and weight >= BLOCK_BYTES:
                yield flush()
                held, weight, made = [], 0, made + 1
    if held:
        yield flush()


class Block:
    """A block's distinct grams by level, and each symbol's place among those that end at it, -1 where there is none.

    Level 0 are words and 1 pairs, by hash; `extend` adds levels 2 and up, by the numbers of their pairs, where all are frequent.
    """

    def __init__(self, row):
        self.sizes = _thick(row.sizes, np.int64)
        ids, hashes = _thick(row.ids, np.int32), np.frombuffer(row.hashes, np.uint64)
        self.told_train = np.unpackbits(np.frombuffer(row.train, np.uint8), count=len(self.sizes)).astype(bool)
        self.train = np.repeat(self.told_train, self.sizes)
        self.place = np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        words = hashes[ids]
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(hashes), np.int32)
        rank[order] = np.arange(len(hashes), dtype=np.int32)
        pairs = np.concatenate([words[:1], _mix(words[:-1], words[1:])]) & GRAM_BITS
        self.keys, self.at = [hashes[order]], [rank[ids]]
        here = self.place >= 1
        keys, at = self._unique(pairs, here)
        self.keys.append(keys)
        self.at.append(at)

    @staticmethod
    def _unique(x: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(x[here], return_inverse=True)
        at = np.full(len(here), -1, np.int32)
        at[here] = back
        return keys, at

    def extend(self, numbers: np.ndarray) -> None:
        """Adds the longer levels, given the number of each pair, 0 where it is rare. numbers[k]: columns of a level's grams."""
        order = np.argsort(numbers, kind="stable")
        rank = np.empty(len(numbers), np.int64)
        rank[order] = np.arange(len(numbers))
        last = np.full(len(self.place), -1, np.int64)
        some = self.at[1] >= 0
        last[some] = np.where(numbers[self.at[1][some]] > 0, rank[self.at[1][some]], -1)
        columns = [numbers[order]]
        self.numbers = [None, [numbers]]
        for k in range(2, DEPTH + 1):
            before = np.concatenate([[-1], last[:-1]])
            here = (before >= 0) & (last >= 0) & (self.place >= k)
            width = max(len(columns[0]), 1)
            keys, at = self._unique(before * width + last, here)
            columns = [c[keys // width] for c in columns] + [columns[-1][keys % width]]
            self.numbers.append(columns)
            self.at.append(at)
            last = at.astype(np.int64)

    def counted(self, k: int, size: int) -> np.ndarray:
        at = self.at[k][self.train]
        return np.bincount(at[at >= 0], minlength=size).astype(np.uint32)

    def ends(self, k: int, size: int) -> np.ndarray:
        """For each gram of a level, a symbol at which it ends."""
        out = np.zeros(size, np.int64)
        some = np.flatnonzero(self.at[k] >= 0)
        out[self.at[k][some]] = some
        return out


def _dealt(part: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places in order) for each part that has any."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cuts[p] : cuts[p + 1]]) for p in np.flatnonzero(np.diff(cuts)).tolist()]


def _hash_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, so that neighbours in a part lie close."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


#: What numbers are weighed with when a gram's part is chosen; `_state_part` says the same in SQL.
WEIGHTS = (1, 31, 1009)


def _number_part(columns: list[np.ndarray], parts: int) -> np.ndarray:
    return (sum(c * np.uint64(w) for c, w in zip(columns, WEIGHTS)) % np.uint64(parts)).astype(np.int32)


def _state_part(parts: int) -> str:
    return f"CAST(IF(level = 1, shiftright(shiftrightunsigned(a, 32) * {parts}L, 32), (a * {WEIGHTS[0]}L + b * {WEIGHTS[1]}L) % {parts}L) AS INT)"


def _requests(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for pdf in batches:
            for row in pdf.itertuples():
                x = Block(row)
                keys, counts = np.concatenate(x.keys), np.concatenate([x.counted(k, len(x.keys[k])) for k in (0, 1)])
                rows = [(p, row.block, int((o < len(x.keys[0])).sum()), _thin_keys(keys[o]), _thin(counts[o])) for p, o in _dealt(_hash_part(keys, parts), parts)]
                yield pd.DataFrame(rows, columns=["part", "block", "words", "keys", "counts"])

    return run


#: Answers to blocks: kind 0 for words and pairs (a counts, b which are owned, c numbers), 2 and up for longer grams (a counts),
#: 10 + level for states (a which are retained, b sizes, c weights of the shorter state).
ANSWER = "block long, part int, kind int, a binary, b binary, c binary"


def _answers(parts: int):
    """One part of the table of words and pairs: for each block that asked its answer; then the words' n and v (block -1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        part = int(pdf.part.iloc[0])
        pdf = pdf.iloc[np.argsort((pdf.block.to_numpy(np.int64) * 40503 + part * 30011) % 65521, kind="stable")]  # owners differ by part
        keys = [_thick_keys(k) for k in pdf["keys"]]
        counts = np.concatenate([_thick(c, np.uint32) for c in pdf["counts"]])
        word = np.concatenate([np.arange(len(k)) < w for k, w in zip(keys, pdf.words)])
        table, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(back, counts, len(table)).astype(np.uint64)
        often = total >= LEAST_COUNT
        own = np.zeros(len(back), bool)
        own[first[often]] = True
        number = np.where(often, np.cumsum(often) * parts + part, 0).astype(np.uint64)
        rows, at = [], 0
        for block, k in zip(pdf.block, keys):
            here = slice(at, at + len(k))
            rows.append((block, part, 0, _thin(total[back[here]]), np.packbits(own[here]).tobytes(), _thin(number[back[here]]), 0, 0))
            at += len(k)
        rows.append((-1, part, 0, b"", b"", b"", int(counts[word].sum()), int((total[np.unique(back[word])] > 0).sum())))
        return pd.DataFrame(rows, columns=["block", "part", "kind", "a", "b", "c", "n", "v"])

    return run


def _told(got: pd.DataFrame, x: Block, parts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Training counts of a block's words and pairs, which pairs it owns, and the pairs' numbers."""
    every = np.concatenate(x.keys)
    order = np.argsort(_hash_part(every, parts), kind="stable")
    c, own, number = np.zeros(len(every), np.int64), np.zeros(len(every), bool), np.zeros(len(every), np.uint64)
    got = got[got.kind == 0].sort_values("part")
    if len(got):
        counts = [_thick(a, np.uint64) for a in got.a]
        c[order] = np.concatenate(counts)
        own[order] = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(t)) for b, t in zip(got.b, counts)]).astype(bool)
        number[order] = np.concatenate([_thick(n, np.uint64) for n in got.c])
    cut = len(x.keys[0])
    return [c[:cut], c[cut:]], own[cut:], number[cut:]


_ROUND = "what int, part int, block long, level int, a binary, b binary, c binary, counts binary"


def _columns(columns: list[np.ndarray], o: np.ndarray) -> list[bytes]:
    """A gram's numbers, sorted by the first: steps of the first, planes of the others; three fields, the last ones empty."""
    return [_thin_keys(columns[0][o]), *(_thin(c[o]) for c in columns[1:]), b"", b""][:3]


def _second_round(parts: int, n: int, v: int):
    """The frequent pairs that a block owns (what 1), its requests for longer grams (2) and for states (3)."""

    def run(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        give_back()
        rows = []
        for row in pdf.itertuples():
            x = Block(row)
            c, own, number = _told(got, x, parts)
            pair = np.flatnonzero(own)
            end = x.ends(1, len(own))[pair]
            before, last = x.at[0][end - 1], x.at[0][end]
            root = (c[0][last] + 1.0) / (n + v + 1.0)
            rows.append((1, -1, row.block, 1, _thin(number[pair]), _thin(x.keys[0][before]), _thin(c[1][pair]), _thin(c[0][before]) + root.tobytes()))
            x.extend(number)
            for k in range(2, DEPTH + 1):
                counts = x.counted(k, len(x.numbers[k][0]))
                for p, o in _dealt(_number_part(x.numbers[k], parts), parts):
                    rows.append((2, p, row.block, k, *_columns(x.numbers[k], o), _thin(counts[o])))
            for k, columns, part in _asked(x, c, number, parts):
                for p, o in _dealt(part, parts) if k < 3 else []:  # of longer contexts the requests for their counts ask as well
                    rows.append((3, p, row.block, k, *_columns(columns, o), b""))
        return pd.DataFrame(rows, columns=["what", "part", "block", "level", "a", "b", "c", "counts"])

    return run


def _asked(x: Block, c: list[np.ndarray], number: np.ndarray, parts: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(level, columns, parts) of the contexts whose states a block asks for: frequent words, frequent pairs, longer candidates."""
    words = x.keys[0][c[0] >= LEAST_COUNT]
    yield 1, [words], _hash_part(words, parts)
    if DEPTH > 1:
        pairs = np.sort(number[number > 0])
        yield 2, [pairs], _number_part([pairs], parts)
    for k in range(3, DEPTH + 1):
        yield k, x.numbers[k - 1], _number_part(x.numbers[k - 1], parts)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The owned pairs as rows."""
    for pdf in batches:
        for r in pdf.itertuples():
            key = _thick(r.a, np.uint64).astype(np.int64)
            whole, root = r.counts[: -8 * len(key)] if len(key) else b"", r.counts[len(r.counts) - 8 * len(key) :]
            if len(key):
                yield pd.DataFrame({"a": key, "context": _thick(r.b, np.uint64).astype(np.int64), "n": _thick(r.c, np.int64), "whole": _thick(whole, np.int64), "root": np.frombuffer(root, float)})


def _longer_answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of the table of longer grams: for each block that asked its counts (kind: the level); then the frequent grams (block -1)."""
    give_back()
    part, rows = int(pdf.part.iloc[0]), []
    for level, x in pdf.groupby("level"):
        sizes = []
        parts_of = [[] for _ in range(level)]
        for r in x.itertuples():
            columns = [_thick_keys(r.a), *(_thick(f, np.uint64) for f in (r.b, r.c)[: level - 1])]
            sizes.append(len(columns[0]))
            for into, column in zip(parts_of, columns):
                into.append(column)
        columns = [np.concatenate(p) for p in parts_of]
        counts = np.concatenate([_thick(f, np.uint32) for f in x.counts])
        order = np.lexsort(columns[::-1])
        sorted_ = [c[order] for c in columns]
        starts = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_], axis=0)]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(starts) - 1
        total = np.bincount(group, counts[order], int(starts.sum())).astype(np.uint64)
        told = np.empty(len(order), np.uint64)
        told[order] = total[group]
        cuts = np.cumsum([0, *sizes])
        rows += [(b, part, level, _thin(told[s:e]), b"", b"", b"") for b, s, e in zip(x.block, cuts, cuts[1:])]
        often = total >= LEAST_COUNT
        kept = [_thin(c[starts][often]) for c in sorted_] + [b""]
        rows.append((-1, part, level, *kept[:3], _thin(total[often])))
    return pd.DataFrame(rows, columns=["block", "part", "kind", "a", "b", "c", "n"])


def _longer_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The longer frequent grams as rows; the third number of a gram of level 2 is 0."""
    for pdf in batches:
        for r in pdf.itertuples():
            columns = [_thick(f, np.uint64).astype(np.int64) for f in (r.a, r.b, r.c)[: r.kind]]
            n = _thick(r.n, np.uint64).astype(np.int64)
            yield pd.DataFrame({"level": r.kind, "a": columns[0], "b": columns[1], "c": columns[2] if r.kind > 2 else np.zeros(len(n), np.int64), "n": n})


def _states(pairs: DataFrame, longer: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(level, a, b, size, back) of the retained contexts: divergence tests, level by level; and the tables stored for that.

    a is a word's hash or a pair's number; a, b are the pairs of a context of three words.

    `below` is a gram's probability in the state of its context's suffix; whole is its context's count.
    """
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("whole") / F.col("below"))).alias("gain")

    def retained(g: DataFrame, level: int) -> DataFrame:
        s = g.groupBy("ca", "cb").agg(gain, F.sum("n").alias("told"), F.count(F.lit(1)).alias("kinds"), F.max("whole").alias("whole"))
        s = s.where((F.col("gain") >= GAIN) & (F.col("gain") >= DIVERGENCE * F.col("whole"))).withColumn("size", F.col("whole") + F.col("kinds"))
        return stored(s.select(F.lit(level).alias("level"), F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("size").cast("double").alias("size"), ((F.col("size") - F.col("told")) / F.col("size")).alias("back")), "states")

    none = F.lit(0).cast("long")
    made = []
    states = every = retained(pairs.select(F.col("context").alias("ca"), none.alias("cb"), "n", "whole", F.col("root").alias("below")), 1)
    made.append(states)
    # of each gram: its own columns ka, kb, its count, its context as the shorter state of the next level, and `below`
    grams = pairs.select(F.col("a").alias("ka"), none.alias("kb"), "n", F.col("context").alias("sa"), none.alias("sb"), F.col("root").alias("lower"))
    counts = grams.select("ka", "kb", "n")
    for k in range(2, DEPTH + 1):
        mine = longer.where(F.col("level") == k)
        if k == 2:  # pairs a and b
            mine = mine.select(F.col("a").alias("ca"), none.alias("cb"), F.col("b").alias("ua"), none.alias("ub"), "n", F.col("a").alias("ka"), F.col("b").alias("kb"))
        else:  # pairs a, b and c: the context is a, b and the suffix b, c
            mine = mine.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("b").alias("ua"), F.col("c").alias("ub"), "n", none.alias("ka"), none.alias("kb"))
        whole = counts.select(F.col("ka").alias("ca"), F.col("kb").alias("cb"), F.col("n").alias("whole"))
        short = grams.select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("n").alias("n_short"), "sa", "sb", "lower")
        state = states.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "size", "back")
        told = mine.join(whole, ["ca", "cb"]).join(short, ["ua", "ub"]).join(state, ["sa", "sb"])
        told = stored(told.select("ca", "cb", "ka", "kb", "n", "whole", (F.col("n_short") / F.col("size") + F.col("back") * F.col("lower")).alias("below")), "grams")
        states = retained(told, k)
        every = every.union(states)
        grams = told.select("ka", "kb", "n", F.col("ca").alias("sa"), F.col("cb").alias("sb"), F.col("below").alias("lower"))
        counts = longer.where(F.col("level") == k).select(F.col("a").alias("ka"), F.col("b").alias("kb"), "n")
        made += [told, states]
    return every, made


def _state_answers(asked: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """For each block and level that asked one part: which of its contexts are retained, and their states, in the order asked."""
    rows = []
    for level, x in asked.groupby("level"):
        s = states[states.level == level]
        s = s.assign(a=s.a.to_numpy(np.int64).astype(np.uint64), b=s.b.to_numpy(np.int64).astype(np.uint64)).sort_values(["a", "b"])
        a, b = s.a.to_numpy(np.uint64), s.b.to_numpy(np.uint64)
        size, back = s["size"].to_numpy(float), s.back.to_numpy(float)
        for r in x.itertuples():
            at = _find(a, _thick_keys(r.a)) if level < 3 else _find_two(a, b, _thick_keys(r.a), _thick(r.b, np.uint64))
            has = at >= 0
            if has.any():
                rows.append((r.block, r.part, 10 + level, np.packbits(has).tobytes(), size[at[has]].tobytes(), back[at[has]].tobytes()))
    return pd.DataFrame(rows, columns=["block", "part", "kind", "a", "b", "c"])


def _find_two(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of pairs (x, y) among different pairs (a, b), -1 where absent."""
    every = np.lexsort((np.concatenate([np.zeros(len(a)), np.ones(len(x))]), np.concatenate([b, y]), np.concatenate([a, x])))
    ca, cb = np.concatenate([a, x])[every], np.concatenate([b, y])[every]
    new = np.concatenate([[True], (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])]) if len(every) else np.zeros(0, bool)
    head = every[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(every) else every  # the first of each group: of the table, if it is there
    out = np.full(len(a) + len(x), -1, np.int64)
    out[every] = np.where(head < len(a), head, -1)
    return out[len(a) :]


class Tree:
    """The same model held whole, for small tables; the tests hold the partitioned one against it. The levels: grams[k] holds the frequent (k+1)-grams as sorted keys, each (place of its first k words) * M + last word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int):
        order = np.argsort(words)
        self.n, self.v = n, v
        self.m = len(words)
        self.grams, self.counts = [words[order]], [counts[order].astype(np.float64)]
        self.back: list[np.ndarray] = []  # per level of contexts: weight of the shorter state; NaN where not retained

    def walk(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, levels: int) -> Iterator[np.ndarray]:
        """Per level, the place of the frequent gram that ends at each symbol and lies within its text, or -1."""
        g = words = _find(self.grams[0], hashes)[ids]
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield g
        for k in range(1, levels):
            key = self._key(g, words, place, k)
            if k < len(self.grams):
                some = np.flatnonzero(key >= 0)
                g = np.full(len(ids), -1, np.int64)
                g[some] = _find(self.grams[k], key[some])
            else:
                g = key
            yield g

    def _key(self, g: np.ndarray, words: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
        """Keys of the (k+1)-grams whose first and last k words are frequent; -1 for the others."""
        before = np.concatenate([[-1], g[:-1]])
        return np.where((before >= 0) & (g >= 0) & (place >= k), before * self.m + words, -1)

    def candidate_keys(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        *_, key = self.walk(ids, sizes, hashes, len(self.grams) + 1)
        return key[key >= 0]

    def add_level(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.grams.append(keys[order])
        self.counts.append(counts[order].astype(np.float64))

    def _suffix(self, k: int) -> np.ndarray:
        """For each gram of level k its place, without the first word, in level k - 1."""
        key = self.grams[k]
        last = key % self.m
        if k == 1:
            return last
        return _find(self.grams[k - 1], self._suffix(k - 1)[key // self.m] * self.m + last)

    def settle(self) -> None:
        """Divergence tests, level by level; sets the weights of the retained contexts."""
        root = (self.counts[0] + 1) / (self.n + self.v + 1)
        shorter = root  # of each gram of level k - 1: its last word's probability in the longest retained state before it
        for k in range(1, len(self.grams)):
            keys, c = self.grams[k], self.counts[k]
            context, size = keys // self.m, len(self.counts[k - 1])
            whole = self.counts[k - 1]
            told = np.bincount(context, c, size)
            kinds = np.bincount(context, minlength=size)
            below = shorter[self._suffix(k)] if len(keys) else np.zeros(0)
            gain = np.bincount(context, c * np.log(c / whole[context] / below), size)
            keep = (gain >= GAIN) & (gain >= DIVERGENCE * whole) & (kinds > 0)
            if k > 1:
                keep &= ~np.isnan(self.back[k - 2][self._suffix(k - 1)])
            back = np.where(keep, (whole - told + kinds) / (whole + kinds), np.nan)
            self.back.append(back)
            b = back[context]
            shorter = np.where(np.isnan(b), below, c / (whole + kinds)[context] + b * below)
        self.kinds = [np.bincount(self.grams[k] // self.m, minlength=len(self.counts[k - 1])) for k in range(1, len(self.grams))]

    def log10(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each symbol at the root, and in its longest retained suffix state. c: its training count."""
        p = root = (c + 1.0) / (self.n + self.v + 1.0)
        levels = list(self.walk(ids, sizes, hashes, len(self.grams)))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for k, back in enumerate(self.back, 1):
            state = np.concatenate([[-1], levels[k - 1][:-1]])
            some = np.flatnonzero((state >= 0) & (place >= k))
            some = some[~np.isnan(back[state[some]])]
            state, gram = state[some], levels[k][some]
            told = np.where(gram >= 0, self.counts[k][gram], 0.0) if len(self.counts[k]) else np.zeros(len(some))
            p = p.copy()
            p[some] = told / (self.counts[k - 1] + self.kinds[k - 1])[state] + back[state] * p[some]
        return np.log10(root), np.log10(p)


def _longer_told(got: pd.DataFrame, x: Block, k: int, parts: int) -> np.ndarray:
    """Training counts of a block's grams of level k."""
    out = np.zeros(len(x.numbers[k][0]), np.int64)
    mine = {r.part: r for r in got[got.kind == k].itertuples()}
    for q, o in _dealt(_number_part(x.numbers[k], parts), parts):
        out[o] = _thick(mine[q].a, np.uint64)
    return out


def score_documents(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_contexts for each document."""
    spark = docs.sparkSession
    d = texts(docs).withColumn("train", ~F.coalesce(held_out("doc_id", modulus), F.lit(False)))
    kind = d.schema["doc_id"].dataType
    # ids go as text: pandas would make fractions of whole numbers that have nulls among them
    coded = d.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_encoded, "block long, doc_ids array<string>, train binary, sizes binary, ids binary, hashes binary, n_bytes long")
    coded = stored(coded, "coded-texts")  # blocks have the names of this one run's partitions
    parts = parts_for(spark, coded.agg(F.sum("n_bytes")).first()[0] or 0, PART_BYTES)
    x = coded.select("block", "train", "sizes", "ids", "hashes")
    asked = x.mapInPandas(_requests(parts), "part int, block long, words int, keys binary, counts binary")
    counted = stored(asked.groupBy("part").applyInPandas(_answers(parts), f"{ANSWER}, n long, v long"), "gram-counts")
    total = counted.where("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(total.n or 0), int(total.v or 0)
    answers = counted.where("block >= 0").drop("n", "v")
    second = stored(x.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_second_round(parts, n, v), _ROUND), "second-round", by="what")
    longer = stored(second.where("what = 2").groupBy("part").applyInPandas(_longer_answers, f"{ANSWER}, n binary"), "longer-grams")
    grams = longer.where("block = -1").mapInPandas(_longer_grams, "level int, a long, b long, c long, n long")
    states, made = _states(second.where("what = 1").mapInPandas(_pairs, "a long, context long, n long, whole long, root double"), grams)
    contexts = states.count()
    dealt = states.withColumn("part", F.expr(_state_part(parts)))
    replies = answers.union(longer.where("block >= 0").drop("n"))
    asks = second.where("what = 3").select("part", "block", "level", "a", "b")
    asks = asks.union(second.where(f"what = 2 AND level < {DEPTH}").select("part", "block", F.col("level") + 1, "a", "b"))
    told = stored(asks.groupBy("part").cogroup(dealt.groupBy("part")).applyInPandas(_state_answers, ANSWER), "state-answers")
    for done in (second, *made):
        forget(done)
    replies = replies.union(told)

    def score(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = []
        for row in pdf.itertuples():
            x = Block(row)
            c, _, number = _told(got, x, parts)
            x.extend(number)
            count = c[0][x.at[0]]
            base = (count + 1.0) / (n + v + 1.0)
            p = base.copy()
            for k, columns, part in _asked(x, c, number, parts):
                # states by the order asked, then by the place of the context
                retained, size, back = np.zeros(len(columns[0]), bool), np.zeros(len(columns[0])), np.zeros(len(columns[0]))
                mine = {r.part: r for r in got[got.kind == 10 + k].itertuples()}
                for q, o in _dealt(part, parts):
                    if r := mine.get(q):
                        o = o[np.unpackbits(np.frombuffer(r.a, np.uint8), count=len(o)).astype(bool)]
                        retained[o], size[o], back[o] = True, np.frombuffer(r.b, float), np.frombuffer(r.c, float)
                if k == 1:
                    state = np.cumsum(c[0] >= LEAST_COUNT) - 1
                    state = np.where(c[0] >= LEAST_COUNT, state, -1)
                elif k == 2:
                    state = np.full(len(number), -1, np.int64)
                    often = np.flatnonzero(number > 0)
                    state[often[np.argsort(number[often], kind="stable")]] = np.arange(len(often))
                else:
                    state = np.arange(len(columns[0]))
                some = np.flatnonzero(x.place >= k)
                at = x.at[k - 1][some - 1]
                some, at = some[at >= 0], state[at[at >= 0]] if len(state) else at[at >= 0]
                some, at = some[at >= 0], at[at >= 0]
                some, at = some[retained[at]], at[retained[at]]
                told = c[1] if k == 1 else _longer_told(got, x, k, parts)
                gram = x.at[k][some]
                explicit = np.where(gram >= 0, told[gram], 0) if len(told) else np.zeros(len(some), np.int64)
                p[some] = np.where(explicit >= LEAST_COUNT, explicit, 0) / size[at] + back[at] * p[some]
            starts = np.cumsum(x.sizes) - x.sizes
            out.append(pd.DataFrame({
                "doc_id": list(row.doc_ids), "held_out": ~x.told_train, "n_tokens": x.sizes,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), starts), "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(base), starts), "score": np.add.reduceat(np.log10(p), starts), "n_contexts": contexts,
            }))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_contexts"])

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_contexts long"
    out = coded.drop("n_bytes").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(score, schema)
    out = stored(out.withColumn("doc_id", F.col("doc_id").cast(kind)), "scores")
    for done in (coded, counted, longer, told):
        forget(done)
    return out
