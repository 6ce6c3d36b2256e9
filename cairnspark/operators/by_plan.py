"""Ordered plans as registered queries, and what they give written anew for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.api import plans
from cairnspark.functions import columns as c
from cairnspark.sources.fixtures import duck, frame


def _folded(relation: str, scope: str, full: str) -> str:
    """Batches by folding a scope's items one by one. `full` decides on (pos, n) before the next item's size is added."""
    new = full.format(pos="a[-1].pos", n="a[-1].n", size="b[1].pos")
    return f"""SELECT {scope}, items[i].item_id AS id, nos[i] AS batch_no FROM (SELECT {scope}, items, unnest(range(1, len(items) + 1)) AS i,
        list_transform(list_reduce(list_transform(items, lambda x: [{{'pos': CAST(x.size AS BIGINT), 'n': CAST(1 AS BIGINT), 'no': CAST(0 AS BIGINT)}}]),
        lambda a, b: a || [CASE WHEN {new} THEN {{'pos': b[1].pos, 'n': CAST(1 AS BIGINT), 'no': a[-1].no + 1}}
            ELSE {{'pos': a[-1].pos + b[1].pos, 'n': a[-1].n + 1, 'no': a[-1].no}} END]), lambda r: r.no) AS nos
        FROM (SELECT {scope}, list({{'item_id': id, 'size': size}} ORDER BY id) AS items FROM ({relation}) r GROUP BY {scope}) t) u"""


_SENT = "SELECT id, project, source, size FROM files WHERE id IN (SELECT carrier_id FROM contents)"
_MEMBERS = f"""SELECT s.id, s.project, s.size, CASE WHEN s.size > 2000 THEN 'file ' || s.id ELSE 'solid ' || s.source || ' ' || b.batch_no END AS member FROM ({_SENT}) s LEFT JOIN
    (SELECT id, batch_no FROM ({_folded(f"SELECT id, project || source AS scope, size FROM ({_SENT}) WHERE size <= 2000", "scope", "{pos} >= 3000")})) b ON s.id = b.id"""

QUERIES = {
    "w08_rotation": (
        lambda s, d: plans.rotation(frame(s, d, "contents"), "project", "carrier_id", target=50_000),
        duck("SELECT project, id AS carrier_id, batch_no AS pack_no FROM (" + _folded("SELECT project, carrier_id AS id, size FROM contents", "project", "{pos} >= 50000") + ")"),
    ),
    "w09_solid_blocks": (lambda s, d: plans.batches(frame(s, d, "files").where("size <= 2000"), "folder", "id", full=6400), duck(_folded("SELECT folder, id, size FROM files WHERE size <= 2000", "folder", "{pos} >= 6400"))),
    "w10_retrieval_batches": (lambda s, d: plans.batches(frame(s, d, "files"), "folder", "id", most=20, limit=51_200), duck(_folded("SELECT folder, id, size FROM files", "folder", "{n} >= 20 OR {pos} + {size} > 51200"))),
    "w14_progress": (
        lambda s, d: plans.running(frame(s, d, "files"), ["project"], "id", F.col("size"), "before", 64).select("id", (F.col("before") + F.col("size")).alias("done")),
        duck("SELECT id, CAST(sum(size) OVER (PARTITION BY project ORDER BY id) AS BIGINT) AS done FROM files"),
    ),
    "w15_chunks": (
        lambda s, d: plans.chunks(frame(s, d, "files"), ["project"], "id", 100).select("id", "chunk"),
        duck("SELECT id, (CAST(row_number() OVER (PARTITION BY project ORDER BY id) AS BIGINT) - 1) // 100 AS chunk FROM files"),
    ),
    "q20_retrieve_plan": (
        lambda s, d: plans.batches(frame(s, d, "files"), "project", "id", most=2000, limit=300_000).join(frame(s, d, "files").select("id", "path", "sha256"), "id")
        .join(frame(s, d, "dest").select("path", F.col("sha256").alias("there")), "path", "left").select("id", "batch_no", F.expr("CASE WHEN there IS NULL THEN 'fetch' WHEN there = sha256 THEN 'skip' ELSE 'keep_both' END").alias("step")),
        duck("SELECT b.id, b.batch_no, CASE WHEN x.path IS NULL THEN 'fetch' WHEN x.sha256 = f.sha256 THEN 'skip' ELSE 'keep_both' END AS step FROM (" + _folded("SELECT project, id, size FROM files", "project", "{n} >= 2000 OR {pos} + {size} > 300000") + ") b JOIN files f ON f.id = b.id LEFT JOIN dest x ON x.path = f.path"),
    ),
    "q11_packing_plan": (
        lambda s, d: plans.packing_plan(frame(s, d, "files").select("id", "project", F.col("source").alias("scope"), "size", "sha256"), 2000, 3000, 40_000),
        duck(f"""SELECT m.id, m.project, m.member, p.batch_no AS pack_no FROM ({_MEMBERS}) m JOIN (SELECT project, member, min(id) AS first FROM ({_MEMBERS}) GROUP BY project, member) k ON k.project = m.project AND k.member = m.member
            JOIN ({_folded(f"SELECT project, min(id) AS id, sum(size) AS size FROM ({_MEMBERS}) GROUP BY project, member", "project", "{pos} >= 40000")}) p ON p.project = k.project AND p.id = k.first"""),
    ),
    "x15_walk_order": (
        lambda s, d: plans.numbered(frame(s, d, "files").where("project = 'es'").select("path"), [F.size(c.parts(F.col("path"))), F.col("path")]),
        duck("SELECT path, CAST(row_number() OVER (ORDER BY len(parts), path) AS BIGINT) AS place FROM files WHERE project = 'es'"),
    ),
}
