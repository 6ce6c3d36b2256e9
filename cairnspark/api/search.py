"""Searching names: an index of words, and ranked hits with filters."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.api.browse import no_case
from cairnspark.functions import columns as c
from cairnspark.functions.search_language import AFTER, Search, parse

K1, B, WEIGHTS, MOST = 1.2, 0.75, (10.0, 1.0), 1000


def tokens(text: Column) -> Column:
    """Array of a text's words: runs of letters and digits, folded."""
    return F.filter(F.split(c.fold_accents(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_index(nodes: DataFrame) -> DataFrame:
    """(id, words, folders): the tokens of each node's name and of the folders above it, composed names also in pieces.

    Folder names are expanded once for each folder, and found through the path's prefixes. The trash is left out.
    """
    live = nodes.where("path IS NOT NULL AND path <> '/'").select("id", "path", "name", "kind")
    up = live.select("id", c.parts(F.col("path")).alias("p")).select("id", F.explode(F.expr("slice(transform(sequence(1, size(p)), i -> struct(i AS depth, concat('/', array_join(slice(p, 1, i), '/')) AS at)), 1, size(p) - 1)")).alias("u"))
    said = live.where("kind = 'd'").select(F.col("path").alias("at"), c.expand(F.col("name")).alias("said"))
    above = up.select("id", "u.depth", "u.at").join(said, "at").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "said"))).alias("a"))
    joined = F.coalesce(F.array_join(F.transform("a", lambda x: x["said"]), " "), F.lit(""))
    return live.join(above, "id", "left").select("id", tokens(c.expand(F.col("name"))).alias("words"), tokens(joined).alias("folders"))


def _terms(q: Search) -> list[tuple[list[str], bool]]:
    """(tokens, whether the last is a beginning) of each word and phrase that has any letter or digit."""
    out = []
    for text, prefix in [(w, True) for w in q.words] + [(p, False) for p in q.phrases]:
        folded = "".join(x for x in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(x))
        found = re.findall(r"[^\W_]+", folded)
        if found:
            out.append((found, prefix))
    return out


def _times(field: str, term: list[str], prefix: bool) -> Column:
    """How often a term stands in an array of tokens."""
    n = len(term)
    test = " AND ".join(
        f"startswith(element_at({field}, i + {k}), '{t}')" if prefix and k == n - 1 else f"element_at({field}, i + {k}) = '{t}'" for k, t in enumerate(term)
    )
    return F.expr(f"IF(size({field}) < {n}, 0, size(filter(sequence(1, size({field}) - {n - 1}), i -> {test})))")


def filters(q: Search) -> Column:
    """The filters over nodes: extension (files only), kind, dates, and sizes (a folder's is its total)."""
    out, low = F.lit(True), F.lower("name")
    for kind, *rest in q.filters:
        if kind == "ext":
            out = out & (F.col("kind") == "f") & (low.endswith(f".{rest[0]}") | F.contains(low, F.lit(f".{rest[0]}.")))
        elif kind == "kind":
            out = out & (F.col("kind") == rest[0])
        elif kind == "size":
            size = F.col("size")
            out = out & {">": size > rest[1], ">=": size >= rest[1], "<": size < rest[1], "<=": size <= rest[1]}[rest[0]]
        else:
            at = F.lit(min(rest[0] * 1_000_000_000, (1 << 63) - 1))  # beyond the last date that nanoseconds can tell: that one
            out = out & ((F.col("mtime_ns") >= at) if kind == AFTER else (F.col("mtime_ns") < at))
    return out


def search(nodes: DataFrame, index: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """Nodes that have every word, phrase and filter of the query, best first, with their rank (`score`, least is best).

    A limit is at most MOST, as the server has it; None gives all that is found.

    Words may stand in the name or in any folder above it, each a beginning; a name counts ten times a folder (bm25).
    Equal scores: folders first, then by name. Without words, what passes the filters. An empty query finds nothing.
    """
    q = parse(query)
    best = lambda found: found if limit is None else found.limit(min(limit, MOST))
    terms = _terms(q)
    live = nodes.where("path IS NOT NULL AND path <> '/'")
    if not (q.words or q.phrases or q.filters) or (not terms and not q.filters):
        return live.where("false").withColumn("score", F.lit(0.0))
    order = [F.col("kind") != "d", no_case(F.col("name")), "path"]
    if not terms:
        return best(live.where(filters(q)).withColumn("score", F.lit(0.0)).orderBy(*order))
    x = index.withColumn("len", F.size("words") + F.size("folders"))
    for k, (term, prefix) in enumerate(terms):
        x = x.withColumn(f"w{k}", _times("words", term, prefix)).withColumn(f"f{k}", _times("folders", term, prefix))
    some = [(F.col(f"w{k}") + F.col(f"f{k}")) > 0 for k in range(len(terms))]
    stats = x.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("mean"), *(F.count_if(s).alias(f"n{k}") for k, s in enumerate(some)))
    hits = x
    for s in some:
        hits = hits.where(s)
    hits = hits.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log((F.col("rows") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        tf = F.col(f"w{k}") * WEIGHTS[0] + F.col(f"f{k}") * WEIGHTS[1]
        score = score - F.greatest(idf, F.lit(1e-6)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    found = live.join(hits.select("id", score.alias("score")), "id").where(filters(q))
    return best(found.orderBy(F.round("score", 9), *order))


def scan(files: DataFrame, query: str, limit: int = MOST, show_hidden: bool = False) -> DataFrame:
    """Plain files whose name has every term, with `truncated`: whether there were more than the limit.

    No index: each term is a part of the name or a pattern for the whole; extension and size filters take files only.
    """
    q = parse(query)
    keep = c.name_matches(F.col("name"), [t.lower() for t in q.words + q.phrases])
    for kind, *rest in q.filters:
        keep = keep & filters(Search(filters=[(kind, *rest)])) & ((F.col("kind") == "f") if kind in ("ext", "size") else F.lit(True))
    keep = keep & ~c.excluded(F.col("name"))
    if not show_hidden:
        keep = keep & ~c.hidden(F.col("path"))
    some = files.where(keep).orderBy("path").limit(limit + 1)  # one more tells whether there are more
    flag = some.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return some.orderBy("path").limit(limit).crossJoin(F.broadcast(flag))


def revalidated(hits: DataFrame, present: DataFrame, root: str) -> DataFrame:
    """Hits of an index that may be stale: those below the root that are still there."""
    return hits.where(c.below(F.col("path"), F.lit(root))).join(present.select("path"), "path", "left_semi")
