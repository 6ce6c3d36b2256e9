"""Byte-level BPE: a lazily determinised transducer for encoding, an incremental UTF-8 machine for decoding.

A rank file fixes which two adjacent tokens may stand side by side (merging their bytes gives back the same two), and
a sequence is the BPE encoding of its bytes exactly if all its neighbours are such pairs. So each prefix of a piece has
one encoding, and its last token alone decides how longer prefixes go on. A state of the transducer is the set of
tokens that have begun and may still end, each with the last token before it; it is built when first entered and kept
under (state, byte), up to a fixed number of states, beyond which new moves are simulated without being kept. Boundaries are emitted once all unfinished tokens agree on them: the lookahead is at most the
longest token. Memory is bounded: pair and piece caches are emptied at a fixed size, long pieces are emitted
as they are read.

Each row is encoded alone in mapInPandas: no shuffle, no skew; a lost executor repeats only its partitions.
Defined results: null and empty texts give no ids (the hash of the empty string); repeated rows repeat; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cairnspark.llm.common import give_back, mapped, texts

START = -1
MOST_STATES, MOST_PAIRS, MOST_PIECES = 40_000, 1_000_000, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [START]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(START)
                node = nxt
            self.ends[node] = rank
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.states: dict[tuple, int] = {((0, START),): 0}
        self.live: list[tuple] = [((0, START),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, bytes]]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain rank-order merging of a few bytes; the pair test rests on it."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if (parts[best] + parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, t: int, right: bool) -> list[tuple[int, bytes]]:
        """(rank, bytes) of what stands at the token's right (left) end while its bytes merge, from one byte to all of it."""
        got = self.spines.get((t, right))
        if got is None:
            whole, out = self.token[t], [(t, self.token[t])]
            while len(whole) > 1:
                halves = self._halves(whole)
                whole = halves[1] if right else halves[0]
                out.append((self.ranks[whole] if len(whole) > 1 else START, whole))
            got = self.spines[t, right] = out[::-1]
        return got

    def _halves(self, whole: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge made this one."""
        parts, limit = [whole[i : i + 1] for i in range(len(whole))], self.ranks[whole]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], limit))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both never joins across the border between them."""
        x, y = self._spine(a, True), self._spine(b, False)
        i, j, never = 0, 0, 1 << 60
        while True:
            joined = self.ranks.get(x[i][1] + y[j][1], never)
            next_x = x[i + 1][0] if i + 1 < len(x) else never
            next_y = y[j + 1][0] if j + 1 < len(y) else never
            if joined < next_x and joined <= next_y:  # of equal ranks the leftmost pair merges first
                return False
            if next_x == next_y == never:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def _advance(self, live, b: int) -> tuple[list, int]:
        """The unfinished tokens after one more byte, and the last token of the prefix that ends here (-1: none)."""
        trie, ends, pairs = self.trie, self.ends, self.pairs
        last, rest = START, []
        for node, before in live:
            nxt = trie[node].get(b)
            if nxt is None:
                continue
            rank = ends[nxt]
            if rank >= 0 and last < 0:
                if before < 0:
                    last = rank
                else:
                    key = before << 32 | rank
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= MOST_PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self.fits(before, rank)
                    if ok:
                        last = rank
            if trie[nxt]:
                rest.append((nxt, before))
        if last >= 0:
            rest.append((0, last))
        return rest, last

    def _step(self, state: int, b: int) -> tuple[int, int]:
        """The kept move from a kept state; a new state is kept with it."""
        rest, last = self._advance(self.live[state], b)
        key = tuple(rest)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.live)
            self.live.append(key)
            self.moves.append({})
        self.moves[state][b] = to, last
        return to, last

    def short_piece(self, data: bytes) -> list[int]:
        """piece() without emission on the way."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        moves, state, ends, token = self.moves, 0, [], self.token
        for i, b in enumerate(data):
            got = moves[state].get(b)
            if got is None:
                if len(self.live) >= MOST_STATES:
                    live = self.live[state]
                    for b in data[i:]:
                        live, last = self._advance(live, b)
                        ends.append(last)
                    break
                got = self._step(state, b)
            state, last = got
            ends.append(last)
        out, at = [], len(data)
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= len(token[t])
        out.reverse()
        return out

    def piece(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece in order, each emitted as soon as all unfinished tokens agree on its end."""
        if len(data) <= 4096:
            yield from self.short_piece(data)
            return
        ends: list[int] = []  # last token of each prefix since `base`
        base, done, state, live = 0, 0, 0, None  # live: the state itself, once it is not among the kept ones
        for i, b in enumerate(data):
            if live is None:
                got = self.moves[state].get(b)
                if got is None and len(self.live) < MOST_STATES:
                    got = self._step(state, b)
                if got is None:
                    live, last = self._advance(self.live[state], b)
                else:
                    state, last = got
            else:
                live, last = self._advance(live, b)
            ends.append(last)
            if i + 1 - base >= 4096:
                begun = self.live[state] if live is None else live
                out, done = self._agreed(ends, base, done, [i + 1 - self._depth(n) for n, _ in begun])
                yield from out
                ends = ends[done - base :]
                base = done
        yield from self._back(ends, base, len(data), done)

    def _depth(self, node: int) -> int:
        if not hasattr(self, "depths"):
            self.depths = [0] * len(self.trie)
            for n, children in enumerate(self.trie):  # a child always comes after its parent
                for c in children.values():
                    self.depths[c] = self.depths[n] + 1
        return self.depths[node]

    def _back(self, ends: list[int], base: int, at: int, stop: int) -> list[int]:
        out = []
        while at > stop:
            t = ends[at - base - 1]
            out.append(t)
            at -= len(self.token[t])
        return out[::-1]

    def _agreed(self, ends, base, done, starts) -> tuple[list[int], int]:
        paths = [self._back(ends, base, s, done) for s in starts if s > done] + [[] for s in starts if s <= done]
        shared: list[int] = []
        for column in zip(*paths):
            if len(set(column)) > 1:
                break
            shared.append(column[0])
        return shared, done + sum(len(self.token[t]) for t in shared)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, older = self.known, self.older
        for p in self.pieces(text):
            got = known.get(p)
            if got is None:
                got = older.get(p)
                if got is None:
                    got = tuple(self.piece(p.encode("utf-8", "surrogatepass")))
                if len(p) <= 64:
                    if len(known) >= MOST_PIECES:  # what was not met for a whole generation goes
                        self.older, self.known = known, {}
                        known, older = self.known, self.older
                    known[p] = got
            out.extend(got)
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(self.token[i]) for i in ids] + [stream.end()])


class Utf8Stream:
    """Incremental UTF-8: bytes may break anywhere; what is complete is returned, malformed bytes become U+FFFD."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end belong to a character that has begun and may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if lead < 0xC2 or lead > 0xF4 or need <= back:
                    return 0
                second = data[-back + 1] if back > 1 else None
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                return back if second is None or low <= second <= high else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self._open(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], Transducer] = {}


def transducer(path: str, pattern: str) -> Transducer:
    """One for each worker process, file and pattern."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Transducer(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>."""
    d = texts(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "ids": [t.encode(x) for x in b.text]})

    return mapped(d, run, "ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "text": [t.decode(x) for x in b.ids]})

    return mapped(encoded.select("doc_id", "ids"), run, "text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids never leave the worker that made them."""
    d = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        t = transducer(path, pattern)
        shown = {rank: str(rank) for rank in t.token}.__getitem__
        for b in batches:
            rows = []
            for at in range(0, len(b), 64):  # texts become strings a few at a time
                for x in b.column(1).slice(at, 64).to_pylist():
                    ids = t.encode(x)
                    stream, back = Utf8Stream(), hashlib.sha256()
                    for i in range(0, len(ids), 8192):
                        back.update(stream.feed(t.decode_bytes(ids[i : i + 8192])).encode())
                    back.update(stream.end().encode())
                    rows.append((len(ids), hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest(), back.hexdigest()))
            n, coded, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
