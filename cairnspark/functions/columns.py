"""Names, paths, numbers and messages as Spark column functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

#: Junk that systems leave in folders.
SYSTEM_JUNK = (".DS_Store", "._*", "Thumbs.db", "ehthumbs.db", "desktop.ini", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", "$RECYCLE.BIN", "System Volume Information")
#: Decimal units, and how clouds are called.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
CLOUDS = {"GoogleDrive": "Google Drive"}
#: Requests that a restricted key may not make, and job states by group.
UNRESTRICTED_ONLY = ("init", "rename", "trash", "restore", "trash_list", "key_authorize", "key_list", "key_revoke")
ACTIVE, FINISHED = ("queued", "running", "waiting"), ("done", "failed", "cancelled")
ERROR_KINDS = ("not_found", "already_exists", "not_a_directory", "invalid_path", "verify", "corrupt", "par2")


def pieces(word: Column) -> Column:
    """Array of a word's camelCase, letter-digit and acronym pieces."""
    borders = ((r"(\p{Ll})(?=\p{Lu})", "$1 "), (r"(\p{L})(?=\p{N})", "$1 "), (r"(\p{N})(?=\p{L})", "$1 "), (r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 "))
    return F.split(reduce(lambda c, b: F.regexp_replace(c, b[0], b[1]), borders, word), " ")


def split_words(name: Column) -> Column:
    """Array of the pieces of every alphanumeric run that has more than one."""
    runs = F.filter(F.split(name, r"[^\p{L}\p{N}]+"), lambda r: r != "")
    return F.flatten(F.filter(F.transform(runs, pieces), lambda p: F.size(p) > 1))


def expand(name: Column) -> Column:
    """The name and, after it, the pieces of its composed words."""
    return F.concat_ws(" ", F.concat(F.array(name), split_words(name)))


def glob(name: Column, pattern: str) -> Column:
    """Whether the whole name fits a pattern of `*` and `?`."""
    special = set(r"\.[]{}()+-^$|&~#")
    return name.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern) + "$")


def excluded(name: Column, patterns: tuple[str, ...] = ()) -> Column:
    """System junk or one of the patterns."""
    return reduce(lambda a, b: a | b, (glob(name, p) for p in (*SYSTEM_JUNK, *patterns)))


def name_matches(name: Column, terms: list[str]) -> Column:
    """Every term is a part of the name or, with a wildcard, fits the whole of it; case does not matter."""
    low = F.lower(name)
    return reduce(lambda a, b: a & b, (glob(low, t.lower()) if set(t) & set("*?") else F.contains(low, F.lit(t.lower())) for t in terms), F.lit(True))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


#: Tenths that lie in the middle of two, as their nearest binary numbers round: 1.05, 1.15, ... to 9.95 with one digit.
_MIDDLES = [f"{(2 * m + 1) / 20:.1f}" for m in range(10, 100)]


def human_bytes(n: Column) -> Column:
    """Decimal units, one digit after the point below ten; in whole numbers, but a middle rounds as a double of it does."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1:], 1):
        scale = 1000**k
        tenths = ((n + scale // 20 - F.pmod(n + scale // 20, F.lit(scale // 10))) / (scale // 10)).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
        middle = F.element_at(F.array(*map(F.lit, _MIDDLES)), (F.floor(n / (scale // 10)) - 9).cast("int"))
        small = F.when(F.pmod(n, F.lit(scale // 10)) == scale // 20, middle).otherwise(text)
        whole, rest = F.floor(n / scale), F.pmod(n, F.lit(scale))
        large = whole + F.when(rest * 2 > scale, 1).when(rest * 2 == scale, F.pmod(whole, F.lit(2))).otherwise(0)
        out = F.when(n >= scale, F.concat(F.when(n < 10 * scale, small).otherwise(large.cast("string")), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    half_up = lambda x: F.floor(x + 0.5)
    hours = F.floor(seconds / 3600)
    text = F.when(seconds < 90, F.concat(F.greatest(F.lit(1), half_up(seconds)).cast("string"), F.lit("s")))
    text = text.when(seconds < 5400, F.concat(half_up(seconds / 60).cast("string"), F.lit("m")))
    text = text.otherwise(F.concat(hours.cast("string"), F.lit("h "), half_up((seconds - hours * 3600) / 60).cast("string"), F.lit("m")))
    infinite = F.isnan(seconds) | (F.abs(seconds) == F.lit(float("inf")))
    return F.when(seconds.isNull() | infinite | (seconds < 0), F.lit("")).otherwise(text)


def windows_name(name: Column) -> Column:
    """Characters that are reserved there become _, trailing dots and spaces go, device names and empty ones get a _."""
    s = F.regexp_replace(F.regexp_replace(name, r'[<>:"\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    s = F.when(s == "", F.lit("_")).otherwise(s)
    stem = F.upper(F.substring_index(s, ".", 1))
    return F.when(stem.rlike("^(CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])$"), F.concat(F.lit("_"), s)).otherwise(s)


def valid_name(name: Column, at_top: Column | None = None) -> Column:
    """A name that a node may have; `.archive` is kept back at the top."""
    bad = name.isin("", ".", "..") | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\0")) | (F.octet_length(name) > 255)
    return ~(bad if at_top is None else bad | (at_top & (name == ".archive")))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def parent(path: Column) -> Column:
    p = parts(path)
    return F.concat(F.lit("/"), F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/"))


def base_name(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-1))


def below(path: Column, top: Column) -> Column:
    """Inside `top`, not `top` itself; the root holds all."""
    t = F.rtrim(top, F.lit("/"))
    return path.startswith(F.concat(t, F.lit("/"))) & (path != F.concat(t, F.lit("/")))


def overlap(a: Column, b: Column) -> Column:
    """The same path, or one inside the other, with either separator."""
    a, b = (F.regexp_replace(x, r"[/\\]+$", "") for x in (a, b))

    def inside(x, y):
        return x.startswith(y) & F.substring(x, F.length(y) + 1, F.lit(1)).isin("/", "\\")

    return (a == b) | inside(a, b) | inside(b, a)


def directly_in(path: Column, folder: Column) -> Column:
    p, d = F.regexp_replace(path, r"[/\\]+$", ""), F.regexp_replace(folder, r"[/\\]+$", "")
    return p.rlike(r"[/\\]") & (F.regexp_replace(F.regexp_replace(p, r"[/\\][^/\\]*$", ""), r"[/\\]+$", "") == d)


def typed_path(path: Column, home: str) -> Column:
    """struct(path, error): `~` is the home folder, `.` and `..` are resolved; a path that is not absolute is an error."""
    p = F.trim(path)
    p = F.when(p == "~", F.lit(home)).when(p.rlike(r"^~[/\\]"), F.concat(F.lit(home + "/"), F.substring(p, F.lit(3), F.length(p)))).otherwise(p)
    walked = F.aggregate(
        parts(p), F.array().cast("array<string>"),
        lambda out, c: F.when(c == ".", out).when(c == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(c))),
    )
    absolute = p.startswith("/")
    error = F.concat(F.lit("Type a full path, starting with / or ~ (not “"), F.trim(path), F.lit("”)."))
    return F.struct(F.when(absolute, F.concat(F.lit("/"), F.array_join(walked, "/"))).alias("path"), F.when(~absolute, error).alias("error"))


def cloud_name(folder: Column) -> Column:
    """`Provider-Account` as a person would say it."""
    provider, account = F.substring_index(folder, "-", 1), F.regexp_extract(folder, "^[^-]*-(.*)$", 1)
    said = reduce(lambda c, kv: F.when(provider == kv[0], F.lit(kv[1])).otherwise(c), CLOUDS.items(), provider)
    return F.when((account == "") | (account == said) | (account == "Box"), said).otherwise(F.concat(said, F.lit(" ("), account, F.lit(")")))


def protected_path(path: Column, home: str) -> Column:
    """Why a path must never be deleted, or null: the top of a disk, or what holds the home folder."""
    n = F.size(parts(path))
    return F.when(n <= 1, F.lit("that is the top level of a disk, not something to delete")).when(
        (F.lit(home) == path) | below(F.lit(home), path), F.lit("that holds your home folder")
    )


def first_digest(text: Column) -> Column:
    """The first word of a checksum file where it is a SHA-256 in hex, else null."""
    word = F.regexp_extract(text, r"^\s*(\S+)", 1)
    return F.when(word.rlike("^[0-9a-fA-F]{64}$"), F.lower(word))


def safe_relative(path: Column) -> Column:
    """A recorded path that stays inside its folder."""
    return (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def tar_number(field: Column) -> Column:
    """A numeric field of a tar header (binary): octal digits, or base 256 where the first bit is set."""
    h = F.hex(field)
    octal = F.conv(F.regexp_extract(field.cast("string"), "([0-7]+)", 1), 8, 10)
    return F.when(F.substring(h, 1, 1) >= "8", F.conv(F.concat(F.lit("0"), F.substring(h, F.lit(2), F.length(h))), 16, 10)).otherwise(octal).cast("long")


def random_id(n_bytes: int = 16) -> Column:
    """A fresh id of so many bytes in hex for each row."""
    made = F.concat(*(F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(-(-n_bytes // 15))))
    return F.substring(made, 1, 2 * n_bytes)


def stable_id(*columns: Column, n_bytes: int = 16) -> Column:
    """An id of so many bytes in hex that depends on the columns only, so that a lost task makes the same one again."""
    return F.substring(F.sha2(F.concat_ws("\0", *(c.cast("string") for c in columns)), 256), 1, 2 * n_bytes)


def error_kind(kind: Column) -> Column:
    """The kind that is told over the wire; all others are `other`."""
    return F.when(kind.isin(*ERROR_KINDS), kind).otherwise(F.lit("other"))


def is_lost(kind: Column, message: Column) -> Column:
    """The connection dropped, so the operation may be tried again."""
    return (kind == "other") & message.startswith("lost the connection")


def allowed(request: Column) -> Column:
    """A request that a restricted key may make."""
    return ~request.isin(*UNRESTRICTED_ONLY)


def last_name(path: Column) -> Column:
    s = F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.when(s == "", path).otherwise(s)


def transfer_title(direction: Column, mode: Column, sources: Column, dest: Column, server: Column) -> Column:
    first = F.coalesce(last_name(F.try_element_at(sources, F.lit(1))), F.lit(""))
    what = F.when(F.size(sources) > 1, F.concat(first, F.lit(" and "), (F.size(sources) - 1).cast("string"), F.lit(" more"))).otherwise(first)
    verb = F.when((direction == "send") & (mode == "move"), F.lit("Moving ")).when(direction == "send", F.lit("Copying ")).otherwise(F.lit("Retrieving "))
    return F.concat(verb, what, F.lit(" → "), F.when(dest.isin("", "/"), server).otherwise(last_name(dest)))


def copy_title(mode: Column, sources: Column, from_server: Column, to_server: Column, dest: Column) -> Column:
    first = F.coalesce(last_name(F.try_element_at(sources, F.lit(1))), F.lit(""))
    what = F.when(F.size(sources) > 1, F.concat(first, F.lit(" and "), (F.size(sources) - 1).cast("string"), F.lit(" more"))).otherwise(first)
    folder = F.when(dest.isin("", "/"), F.lit("")).otherwise(last_name(dest))
    place = F.when(to_server.isNotNull(), F.trim(F.concat(to_server, F.lit(" "), folder))).otherwise(folder)
    came = F.coalesce(F.concat(F.lit(" from "), from_server), F.lit(""))
    return F.concat(F.when(mode == "move", F.lit("Moving ")).otherwise(F.lit("Copying ")), what, came, F.lit(" → "), place)


def completion(typed: Column, names: Column) -> Column:
    """What a typed last part becomes, given the folder's names: the common beginning of those that fit, or null.

    Names fit with their case, or where none does without it; a single one is completed wholly.
    """
    fit = F.filter(names, lambda n: n.startswith(typed))
    fit = F.when(F.size(fit) > 0, fit).otherwise(F.filter(names, lambda n: F.lower(n).startswith(F.lower(typed))))
    low, high = F.array_min(fit), F.array_max(fit)
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)))
    common = F.when((F.length(low) == 0) | (F.length(high) == 0), F.lit("")).otherwise(F.substring(low, F.lit(1), same))
    return F.when(F.size(fit) == 1, F.element_at(fit, 1)).when(F.size(fit) > 1, F.when(F.length(common) > F.length(typed), common).otherwise(typed))


@pandas_udf(StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Lower case without marks, as words are compared; no built-in function normalises."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)))


@pandas_udf(BooleanType())
def incompressible(sample: pd.Series) -> pd.Series:
    """A sample of 4,096 bytes or more that a fast compressor leaves above 97 % of its size."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    return sample.map(lambda b: b is not None and len(b) >= 4096 and len(squeeze(bytes(b))) > 0.97 * len(b))


def civil_days(seconds: Column) -> Column:
    """Days since 1970-01-01 of a time in seconds, before it too."""
    return F.floor(seconds / 86_400).cast("int")


def day_text(day: Column) -> Column:
    """A date as year-month-day: years from 0 have four digits or more without a sign, those before 0 a minus and no zeros in front."""
    year = F.year(day)
    told = F.when((year >= 0) & (year < 1000), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(told, F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.day(day).cast("string"), 2, "0"))


def solid_member(pack: Column, number: Column) -> Column:
    """The member that a pack keeps its so-manieth block of small files in."""
    return F.format_string(".archive/solid-%08d-%05d.tar.zst", pack, number)


def like_literal(text: Column) -> Column:
    """A text as itself inside a LIKE pattern whose escape is a backslash."""
    for special in ("\\", "%", "_"):
        text = F.replace(text, F.lit(special), F.lit("\\" + special))
    return text
