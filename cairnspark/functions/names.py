"""Name, path, date and size expressions (scalar operators), written once for both engines."""

from __future__ import annotations


def pieces(d, x: str) -> str:
    """camelCase, letter-digit and acronym borders become spaces."""
    for p, r in ((r"(\p{Ll})(\p{Lu})", "$1 $2"), (r"(\p{L})(\p{N})", "$1 $2"), (r"(\p{N})(\p{L})", "$1 $2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")):
        x = d.sub(x, p, r)
    return x


def stem(d, name: str) -> str:
    """Before the last dot, unless that dot leads the name."""
    return f"CASE WHEN {d.rlike(name, '^.+[.][^.]*$')} THEN {d.extract(name, '^(.+)[.][^.]*$', 1)} ELSE {name} END"


def suffix(d, name: str) -> str:
    return f"CASE WHEN {d.rlike(name, '^.+[.][^.]*$')} THEN {d.extract(name, '^.+([.][^.]*)$', 1)} ELSE '' END"


def numbered(d, name: str, n: str) -> str:
    return f"{stem(d, name)} || ' (' || CAST({n} AS {d.text}) || ')' || {suffix(d, name)}"


def tsv(x: str) -> str:
    for code, letter in ((92, 92), (9, 116), (10, 110), (13, 114)):
        x = f"replace({x}, chr({code}), chr(92) || chr({letter}))"
    return x


def share(d, e: str) -> str:
    """A content's part of a solid block's stored bytes, in whole numbers."""
    return f"CASE WHEN {e}.blob_kind = 's' AND {e}.raw_len > 0 THEN {d.div(f'{e}.data_len * {e}.size', f'{e}.raw_len')} ELSE {e}.data_len END"
