"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules share one multiword Shift-And register. Bit i stands for pattern character i; a batch of URLs advances
one character at a time, every pattern of every URL at once: D' = ((D << 1 | first) & mask[c]) | (D & star). A `*` is
no position of its own: it lets the position before it stay set, and an empty start position keeps leading stars alive.

The allow and block rules of a list are (host, path) prefixes compiled to globs over `host\\x01path`; the longest rule
that matches wins. Without one the blocking globs decide. URLs of a batch are sorted by length, so a few very
long ones do not make the others walk. Each row is judged alone: no shuffle, no state, no skew.

Defined results: a null url, or one without `://`, has empty host and path and is judged as such (no rule, the globs
see an empty URL); repeated rows give repeated results; columns besides page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import ascii_lower, mapped

SEP = "\x01"
#: Fixed values: (verdict, host, path) of the base list.
BASE_RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
#: Globs over the canonical URL `host` + path that block where no listed rule fits.
BLOCK_GLOBS = (
    "ads.*", "*.ads.*", "ad.*", "adserver.*", "track.*", "tracker.*", "*.doubleclick.*", "*/ads/*", "*/adserver/*", "*/banner*.gif",
    "*/login*", "*/signin*", "*/signup*", "*/cart*", "*/checkout*", "*/wp-admin*", "*/wp-login*", "*/cgi-bin/*", "*/search/*",
    "*.exe", "*.zip", "*.tar.gz", "*.jpg", "*.png", "*.gif", "*.css", "*.js", "*casino*", "*poker*", "*porn*", "*xxx*", "*viagra*",
    "*.onion/*", "*/feed/", "*/rss/*", "*/tag/*/page/*", "*/calendar/????/??/*",
)


class ShiftAnd:
    """Globs (`*` any run, `?` any character) matched whole against strings, all at once over a batch."""

    def __init__(self, globs: list[str]):
        self.first, self.last, self.star, self.nothing = [], [], [], []
        chars: list[str | None] = []  # per bit: the character, None for `?`; an empty start bit opens each pattern
        for g in globs:
            start = len(chars)
            chars.append("")
            self.star.append(g.startswith("*"))
            for c in g:
                if c == "*":
                    self.star[-1] = True
                else:
                    chars.append(None if c == "?" else c)
                    self.star.append(False)
            self.first.append(start)
            self.last.append(len(chars) - 1)
        self.n = len(chars)
        self.words = max(1, -(-self.n // 64))
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for c in chars if c}))}  # 0: any other character
        bits = np.zeros((len(self.alphabet) + 1, self.n), bool)
        for i, c in enumerate(chars):
            if c is None:
                bits[:, i] = True
            elif c:
                bits[self.alphabet[c], i] = True
        self.mask = self._pack(bits)
        self.stay = self._pack(np.array([self.star], bool).reshape(1, self.n))[0]
        begin = np.zeros((1, self.n), bool)
        begin[0, self.first] = True
        self.begin = self._pack(begin)[0]
        self.table = np.zeros(0x110000 if any(ord(c) > 255 for c in self.alphabet) else 256, np.uint16)
        for c, i in self.alphabet.items():
            self.table[ord(c)] = i

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), self.words * 64), np.uint8)
        out[:, : self.n] = bits
        return np.packbits(out, axis=1, bitorder="little").view("<u8")

    def match(self, strings: list[str]) -> np.ndarray:
        """Boolean (strings, globs)."""
        n = len(strings)
        out = np.zeros((n, len(self.first)), bool)
        if not n or not self.n:
            return out
        order = sorted(range(n), key=lambda i: -len(strings[i]))
        lengths = np.array([len(strings[i]) for i in order])
        codes = [self._codes(strings[i]) for i in order]
        state = np.broadcast_to(self.begin, (n, self.words)).copy()
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for j in range(int(lengths[0]) if n else 0):
            while live and lengths[live - 1] <= j:
                live -= 1
            at = np.fromiter((c[j] for c in codes[:live]), np.intp, live)
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.mask[at]) | (d & self.stay)
        for k, bit in enumerate(self.last):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return out

    def _codes(self, s: str) -> np.ndarray:
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        return self.table[np.where(points < len(self.table), points, 0)]


def compile_rules(rules, globs) -> tuple[ShiftAnd, list[tuple[int, str, str]]]:
    """The automaton, and per leading glob (length, verdict, shown rule). Each rule takes two globs: its host, subdomains."""
    made, about = [], []
    for verdict, host, path in rules:
        for g in (f"{host}{SEP}{path}*", f"*.{host}{SEP}{path}*"):
            made.append(g)
            about.append((len(host) + len(path), verdict, host + path))
    return ShiftAnd([*made, *globs_on_canonical(globs)]), about


def globs_on_canonical(globs) -> list[str]:
    """A glob's first `/` after host characters meets the separator that stands before the path."""
    return [g.replace("/", f"{SEP}/", 1) if "/" in g and not g.startswith("*/") else g for g in globs]


def canonical(urls: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path): SQL functions only."""
    d = urls.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
    d = d.withColumn("rest", F.expr("IF(instr(u, '://') > 0, substring(u, instr(u, '://') + 3), '')"))
    return d.select(
        "page_id",
        ascii_lower(F.regexp_extract("rest", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def judge_urls(urls: DataFrame, rules=BASE_RULES, globs=BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row."""
    automaton, about = compile_rules(rules, globs)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = automaton.match([f"{h}{SEP}{p}" for h, p in zip(b.host, b.path)])
            n = len(about)
            size = np.where(hit[:, :n], np.array([a[0] for a in about], int).reshape(1, n), -1)
            best = size.argmax(1) if n else np.zeros(len(b), int)
            ruled = size.max(1, initial=-1) >= 0
            blocked = hit[:, n:].any(1)
            shown = np.array([a[2] for a in about] + [None], object)
            verdict = np.array([a[1] for a in about] + [""], object)
            b = b.assign(
                rule=np.where(ruled, shown[best], None),
                verdict=np.where(ruled, verdict[best], np.where(blocked, "block", "allow")),
            )
            yield b

    c = canonical(urls, id_col, url_col)
    return mapped(c, judge, "host string, path string, rule string, verdict string", "page_id")
