"""The search language: words, "phrases" and filters, read on the driver and compiled to one predicate over files.

A token that looks like a filter but is not one (an unknown `is:`, a date or size that cannot be read) stays a word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

# fixed values: filter names and decimal size units
EXTENSION, AFTER, BEFORE, KIND = ("type", "ext"), "after", "before", "is"
FOLDER_WORDS, FILE_WORDS = {"folder", "folders", "dir", "directory"}, {"file", "files"}
UNITS = {"": 1e0, "k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "p": 1e15}

_TOKEN = re.compile(r'"([^"]*)"?|(\S+)')
_SIZE = re.compile(r"([0-9.]+)([kmgtp]?)i*b*")
_COMPARED = re.compile(r"(?:size:)?([<>]=?)(.*)", re.S)
_EPOCH = date(1970, 1, 1).toordinal()


@dataclass
class Search:
    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    filters: list[tuple] = field(default_factory=list)


def size_of(text: str) -> int | None:
    """Bytes of "2.5tb", "12m", "64": decimal units, also when written as kib."""
    m = _SIZE.fullmatch(text)
    try:
        return int(float(m[1]) * UNITS[m[2]]) if m else None
    except ValueError:
        return None


def start_of(text: str) -> int | None:
    """Epoch seconds at which a year, month or day begins; days past the month's end run on into the next."""
    parts = [*text.split("-"), "1", "1"][:3]
    if not all(re.fullmatch(r"\+?[0-9]+", p) for p in parts):
        return None
    y, m, d = map(int, parts)
    if not (1900 <= y <= 3000 and 1 <= m <= 12 and 1 <= d <= 31):
        return None
    return (date(y, m, 1).toordinal() + d - 1 - _EPOCH) * 86_400


def filter_of(token: str) -> tuple | None:
    low = token.lower()
    name, colon, value = low.partition(":")
    if colon and name in EXTENSION:
        value = value.lstrip(".")
        return ("ext", value) if value else None
    if colon and name == KIND:
        return ("kind", "d") if value in FOLDER_WORDS else ("kind", "f") if value in FILE_WORDS else None
    if colon and name in (AFTER, BEFORE):
        at = start_of(value)
        return None if at is None else (name, at)
    m = _COMPARED.fullmatch(low)
    size = size_of(m[2]) if m else None
    return None if size is None else ("size", m[1], size)


def parse(text: str) -> Search:
    out = Search()
    for m in _TOKEN.finditer(text.strip()):
        if m[2] is None:
            out.phrases += [m[1].strip()] if m[1].strip() else []
        elif found := filter_of(m[2]):
            out.filters.append(found)
        else:
            out.words.append(m[2])
    return out


def _literal(d, text: str) -> str:
    return "'" + (text.replace("\\", "\\\\").replace("'", "\\'") if d.name == "spark" else text.replace("'", "''")) + "'"


def predicate(d, search: Search, fields: list[str]) -> str:
    """SQL condition over files. `fields` are expressions of the indexed texts: lower-case tokens, each after a space,
    and a space at the end. A word's tokens stand together in one field, the last one as a prefix; a phrase's are whole."""
    terms = []
    for text, end in [(w, "") for w in search.words] + [(p, " ") for p in search.phrases]:
        tokens = re.findall(r"[a-z0-9]+", text.lower())
        if tokens:
            terms.append("(" + " OR ".join(f"contains({f}, {_literal(d, ' ' + ' '.join(tokens) + end)})" for f in fields) + ")")
    for kind, *rest in search.filters:
        if kind == "ext":
            e = "." + rest[0]
            terms.append(f"(right(lower(name), {len(e)}) = {_literal(d, e)} OR contains(lower(name), {_literal(d, e + '.')}))")
        elif kind == "kind":
            terms.append("true" if rest[0] == "f" else "false")
        elif kind == "size":
            terms.append(f"size {rest[0]} {rest[1]}")
        else:
            terms.append(f"mtime_ns {'>=' if kind == AFTER else '<'} {rest[0] * 1_000_000_000}")
    return " AND ".join(terms) if terms else "false"


def match_text(search: Search) -> str | None:
    """The words and phrases as a full-text index takes them: quoted, words as beginnings; None where none has a letter or digit."""
    parts = [f'"{w.replace(chr(34), chr(34) * 2)}"*' for w in search.words if any(map(str.isalnum, w))]
    parts += [f'"{p.replace(chr(34), chr(34) * 2)}"' for p in search.phrases if any(map(str.isalnum, p))]
    return " ".join(parts) or None
