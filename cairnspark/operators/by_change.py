"""Mutations and maintenance as registered queries, and what they give written anew for the other engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cairnspark.api import changes, transfers
from cairnspark.functions import columns as c
from cairnspark.functions.search_language import parse
from cairnspark.plans.dialect import Spark
from cairnspark.sources.fixtures import T0, duck, frame, statement

_WANTED = "SELECT '/Library/' || project || '/new/' || source || CASE WHEN id % 2 = 0 THEN '/deep' ELSE '' END AS path, id FROM files"
_STORED = "SELECT c.project, c.sha256, CASE WHEN b.kind = 's' AND b.raw_len > 0 THEN {div} ELSE b.data_len END AS stored FROM content_blobs c JOIN blobs b ON c.blob_id = b.blob_id AND c.project = b.project"
_TERMS = [t.lower() for q in [parse('Alpha "Two Words" is:odd beta size:>1k')] for t in q.words + q.phrases]


def _contents(s, d):
    return frame(s, d, "content_blobs").select("project", "sha256", "blob_id", "size", F.lit(1).alias("refs"))


def _purged(name: str, select):
    def run(s, d):
        out = changes.purge(frame(s, d, "nodes"), _contents(s, d), frame(s, d, "blobs"), frame(s, d, "packs"), T0 + 2_000_000)
        return select(out[name])

    return run


#: What stays and goes, said the other way round: by the files that are left.
_PURGE_DUCK = f"""stay AS (SELECT * FROM nodes WHERE trashed_at IS NULL OR trashed_at >= {T0 + 2_000_000}), used AS (SELECT DISTINCT b.pack_id, b.project FROM stay n JOIN content_blobs c ON n.project = c.project AND n.sha256 = c.sha256
    JOIN blobs b ON b.blob_id = c.blob_id AND b.project = c.project WHERE n.kind = 'f'), dead AS (SELECT * FROM packs p WHERE p.state <> 'open' AND (p.pack_id, p.project) NOT IN (SELECT (pack_id, project) FROM used))"""


def _with(select: str) -> str:
    whole = duck("SELECT 1 FROM nodes, packs, blobs, content_blobs")
    return whole[: whole.rindex("SELECT 1 FROM nodes")].rstrip() + ", " + select


def _stored(s, d):
    return s.sql(statement(Spark(d), _STORED.format(div="(b.data_len * c.size) div b.raw_len")))


def _free(s, d):
    f = frame(s, d, "files")
    taken = f.where("doc_id % 3 <> 0").selectExpr("folder || '/report (' || CAST(2 + doc_id % 11 AS STRING) || ').tar.gz' AS path").union(f.selectExpr("folder || '/report (02).tar.gz'")).union(f.selectExpr("folder || '/report (9).txt'"))
    return changes.free_names(f.selectExpr("id", "CASE WHEN id % 4 = 0 THEN path ELSE folder || '/report.tar.gz' END AS path"), taken).select("id", "n", "free")


QUERIES = {
    "w13_free_name": (
        _free,
        duck("""SELECT id, n, CASE WHEN id % 4 = 0 THEN regexp_replace(path, '^(.*)([.][^.]*)$', '\\1 (' || n || ')\\2') ELSE folder || '/report.tar (' || n || ').gz' END AS free FROM (
            SELECT id, path, folder, CAST(2 AS BIGINT) AS n FROM files) t"""),
    ),
    "w13_free_name_taken": (
        lambda s, d: (lambda f: changes.free_names(f.selectExpr("id", "folder || '/report.gz' AS path"), f.where("doc_id % 3 <> 0").selectExpr("folder || '/report (' || CAST(2 + doc_id % 11 AS STRING) || ').gz' AS path")).select("id", "n", "free"))(frame(s, d, "files")),
        duck("""SELECT f.id, g.n, f.folder || '/report (' || g.n || ').gz' AS free FROM files f JOIN (SELECT folder, min(n) AS n FROM (SELECT DISTINCT folder FROM files) a, (SELECT unnest(range(2, 14)) AS n) b
            WHERE NOT EXISTS (SELECT 1 FROM files t WHERE t.folder = a.folder AND t.doc_id % 3 <> 0 AND 2 + t.doc_id % 11 = b.n) GROUP BY folder) g ON f.folder = g.folder"""),
    ),
    "q37_mkdir_p": (
        lambda s, d: (lambda n: (lambda x: x.join(n.select("id"), "id", "left_anti").alias("m").join(x.select(F.col("id").alias("parent"), F.col("path").alias("up")), "parent").select("m.path", "m.name", "m.project", "up"))(
            changes.mkdirs(n, frame(s, d, "files").selectExpr("'/Library/' || project || '/new/' || source || CASE WHEN id % 2 = 0 THEN '/deep' ELSE '' END AS path"), T0)))(frame(s, d, "nodes")),
        duck(f"""SELECT path, regexp_extract(path, '[^/]*$') AS name, string_split(path, '/')[3] AS project, regexp_extract(path, '^(.*)/[^/]*$', 1) AS up FROM (
            SELECT path FROM ({_WANTED}) UNION SELECT regexp_replace(path, '/deep$', '') FROM ({_WANTED}) UNION SELECT '/Library/' || project || '/new' FROM files)"""),
    ),
    "q37_projects": (
        lambda s, d: changes.create_projects(frame(s, d, "nodes").withColumn("project", F.when(F.col("project") != "fr", F.col("project"))), frame(s, d, "projects").where("project <> 'fr'"), frame(s, d, "nodes").where("path LIKE '/Library/%' AND kind = 'd'").select("id"), T0)[2].select("path", "status"),
        duck("SELECT path, CASE WHEN project = 'fr' THEN 'created' WHEN path IN ('/Library/en', '/Library/de', '/Library/es') THEN 'exists' ELSE 'inside a project' END AS status FROM nodes WHERE path LIKE '/Library/%' AND kind = 'd'"),
    ),
    "q37_symlinks": (
        lambda s, d: changes.insert_symlinks(frame(s, d, "nodes"), frame(s, d, "files").selectExpr("CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN folder || '/link-' || name WHEN 2 THEN folder || '/none/' || name ELSE '/.archive' END AS path", "'x' AS target", "0L AS mtime_ns").distinct(), T0)[1],
        duck("""SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN folder || '/link-' || name WHEN 2 THEN folder || '/none/' || name ELSE '/.archive' END AS path,
            CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 17 = 0 THEN 'created' ELSE 'already exists' END WHEN 1 THEN 'created' WHEN 2 THEN 'no folder' ELSE 'invalid name' END AS status FROM files"""),
    ),
    "j13_inherit_project": (
        lambda s, d: changes.inherit_project(frame(s, d, "nodes").where("kind = 'f'").select("id", "parent", "project"), frame(s, d, "nodes").where("kind = 'd'")).select("id", "project"),
        duck("SELECT id, CASE WHEN trashed_at IS NULL THEN project END AS project FROM nodes WHERE kind = 'f'"),
    ),
    "j12_delete_in": (
        lambda s, d: changes.delete_in(frame(s, d, "contents"), frame(s, d, "trashed"), ["project", "sha256"]).select("project", "sha256", "refs"),
        duck("SELECT project, sha256, refs FROM contents c WHERE NOT EXISTS (SELECT 1 FROM trashed t WHERE t.project = c.project AND t.sha256 = c.sha256)"),
    ),
    "u04_insert_or_ignore": (
        lambda s, d: changes.insert_or_ignore(frame(s, d, "dest").select("path", "size"), frame(s, d, "files").select("path", F.lit(-1).cast("bigint").alias("size")), ["path"]),
        duck("SELECT f.path, coalesce(x.size, -1) AS size FROM files f LEFT JOIN dest x USING (path)"),
    ),
    "u04_upsert": (
        lambda s, d: changes.upsert(frame(s, d, "jobs").select("job_id", "state", F.col("updated")), frame(s, d, "job_events").select("job_id", "state", F.col("secs").alias("updated"), "event_id").where("job_id % 2 = 0"), ["job_id"], F.struct("updated", "event_id")).select("job_id", "state"),
        duck("SELECT j.job_id, CASE WHEN j.job_id % 2 = 0 THEN (SELECT e.state FROM job_events e WHERE e.job_id = j.job_id ORDER BY e.secs DESC, e.event_id DESC LIMIT 1) ELSE j.state END AS state FROM jobs j"),
    ),
    "u05_terms": (
        lambda s, d: s.range(1).select(F.explode(F.array(*[F.lit(x) for x in _TERMS])).alias("term")),
        "SELECT unnest(['alpha', 'is:odd', 'beta', 'two words']) AS term",
    ),
    "u06_created": (
        lambda s, d: frame(s, d, "files").groupBy("folder").agg(F.sort_array(F.collect_list("name")).alias("a")).select("folder", F.array_join(changes.union_created(F.slice("a", 1, 3), F.slice("a", 2, 3)), "|").alias("created")),
        duck("SELECT folder, array_to_string((list_sort(list(name)))[1:4], '|') AS created FROM files GROUP BY folder"),
    ),
    "q28_trash": (
        lambda s, d: changes.trash(frame(s, d, "nodes"), frame(s, d, "nodes").where("path IN ('/Library/en/src1', '/Library/de') OR id % 10 = 3").select("id"), T0 + 7).selectExpr("id", "coalesce(parent, -1L) AS parent", "name", "path", "trash_origin", "coalesce(trashed_at, -1L) AS trashed_at"),
        duck(f"""SELECT n.id, coalesce(CASE WHEN t.top THEN 2 ELSE n.parent END, -1) AS parent, CASE WHEN t.top THEN CAST(n.id AS VARCHAR) ELSE n.name END AS name,
            CASE WHEN t.top OR starts_with(n.path, '/Library/en/src1/') OR starts_with(n.path, '/Library/de/') OR EXISTS (SELECT 1 FROM nodes a WHERE a.id % 10 = 3 AND a.kind = 'd' AND starts_with(n.path, a.path || '/')) THEN NULL ELSE n.path END AS path,
            CASE WHEN t.top THEN n.path ELSE n.trash_origin END AS trash_origin, coalesce(CASE WHEN t.top THEN {T0 + 7} ELSE n.trashed_at END, -1) AS trashed_at
            FROM nodes n JOIN (SELECT id, path IS NOT NULL AND path <> '/' AND (path IN ('/Library/en/src1', '/Library/de') OR id % 10 = 3) AS top FROM nodes) t ON n.id = t.id"""),
    ),
    "q28_restore": (
        lambda s, d: changes.restore(frame(s, d, "nodes"), frame(s, d, "trashed").where("id % 2 = 0").select("id"))[0].selectExpr("id", "coalesce(parent, -1L) AS parent", "name", "path", "coalesce(trashed_at, -1L) AS trashed_at"),
        duck("""SELECT n.id, coalesce(CASE WHEN n.trashed_at IS NOT NULL AND n.id % 2 = 0 THEN (SELECT id FROM nodes WHERE path = f.folder) ELSE n.parent END, -1) AS parent, CASE WHEN n.trashed_at IS NOT NULL AND n.id % 2 = 0 THEN f.name ELSE n.name END AS name,
            CASE WHEN n.trashed_at IS NOT NULL AND n.id % 2 = 0 THEN f.path ELSE n.path END AS path, coalesce(CASE WHEN n.id % 2 = 0 THEN NULL ELSE n.trashed_at END, -1) AS trashed_at FROM nodes n LEFT JOIN files f ON f.id = n.id AND n.kind = 'f'"""),
    ),
    "q28_restore_outcome": (
        lambda s, d: (lambda n: changes.restore(n.union(n.where("trashed_at IS NOT NULL AND id % 4 = 0").selectExpr("-id", "parent", "trash_origin", "'x'", "kind", "project", "sha256", "size", "mtime_ns", "created", "NULL", "NULL")).where("path IS NULL OR path NOT LIKE '/Library/fr%'"), frame(s, d, "trashed").select("id"))[1].select("id", "status"))(frame(s, d, "nodes")),
        duck("SELECT id, CASE WHEN id % 4 = 0 AND project <> 'fr' THEN 'already exists' WHEN project = 'fr' THEN 'no folder' ELSE 'restored' END AS status FROM trashed"),
    ),
    "x09_trash_list": (lambda s, d: changes.trash_list(frame(s, d, "nodes")), duck("SELECT id, regexp_extract(path, '[^/]*$') AS name, path AS trash_origin, 'f' AS kind, size, trashed_at FROM trashed")),
    "q29_move": (
        lambda s, d: changes.set_totals(changes.move(frame(s, d, "nodes"), "/Library/fr/src1", "/Library/de/moved")).where("path IS NOT NULL").select("id", "path", "name", "size"),
        duck("""SELECT n.id, m.now AS path, CASE WHEN n.path = '/Library/fr/src1' THEN 'moved' ELSE n.name END AS name, CASE WHEN n.kind = 'd' THEN (SELECT CAST(coalesce(sum(f.size), 0) AS BIGINT) FROM nodes f JOIN (SELECT id, CASE WHEN path = '/Library/fr/src1' OR path LIKE '/Library/fr/src1/%'
            THEN '/Library/de/moved' || substring(path, 17) ELSE path END AS now FROM nodes) k ON k.id = f.id WHERE f.kind = 'f' AND k.now IS NOT NULL AND (m.now = '/' OR starts_with(k.now, m.now || '/'))) ELSE n.size END AS size
            FROM nodes n JOIN (SELECT id, CASE WHEN path = '/Library/fr/src1' OR path LIKE '/Library/fr/src1/%' THEN '/Library/de/moved' || substring(path, 17) ELSE path END AS now FROM nodes) m ON m.id = n.id WHERE n.path IS NOT NULL"""),
    ),
    "j27_move_refusal": (
        lambda s, d: reduce(lambda a, b: a.union(b), [changes.move_refusal(frame(s, d, "nodes"), a, b).select(F.lit(f"{a} {b}").alias("move"), "why") for a, b in _MOVES]),
        "SELECT unnest(['/Library/fr /Library/fr/src1/x', '/Library/fr /Library/de', '/Library/xx /Library/y', '/Library/fr /nowhere/z', '/Library/fr /Library/new', '/ /x', '/Library /.archive']) AS move, unnest(['cannot move a folder into itself', 'already exists', 'not found', 'no folder', NULL, 'cannot move the archive root', 'invalid name']) AS why",
    ),
    "a04_totals_now": (
        lambda s, d: changes.set_totals(frame(s, d, "nodes").withColumn("size", F.when(F.col("kind") == "d", F.lit(-1)).otherwise(F.col("size")))).select("id", "size"),
        duck("SELECT id, CASE WHEN path = '/' THEN (SELECT CAST(sum(size) AS BIGINT) FROM nodes WHERE kind = 'f' AND path IS NOT NULL) WHEN id = 2 THEN -1 ELSE size END AS size FROM nodes"),
    ),
    "q33_recount": (
        lambda s, d: changes.carried(frame(s, d, "nodes"), _stored(s, d)).select("id", "stored"),
        _with(f"""own AS (SELECT n.id, n.path, CASE WHEN n.id = (SELECT min(m.id) FROM nodes m WHERE m.project = n.project AND m.sha256 = n.sha256) THEN (SELECT t.stored FROM ({_STORED.format(div='(b.data_len * c.size) // b.raw_len')}) t WHERE t.project = n.project AND t.sha256 = n.sha256) ELSE 0 END AS stored FROM nodes n WHERE n.kind = 'f')
            SELECT n.id, CAST(CASE WHEN n.kind = 'f' THEN (SELECT stored FROM own WHERE own.id = n.id) WHEN n.id = 2 THEN (SELECT coalesce(sum(stored), 0) FROM own WHERE path IS NULL) WHEN n.id = 1 THEN (SELECT sum(stored) FROM own WHERE path IS NOT NULL)
            ELSE (SELECT coalesce(sum(stored), 0) FROM own WHERE starts_with(own.path, n.path || '/')) END AS BIGINT) AS stored FROM nodes n"""),
    ),
    "j24_heirs": (
        lambda s, d: changes.heirs(frame(s, d, "nodes"), frame(s, d, "nodes").where("id % 3 = 0").select("id"), _stored(s, d).select("project", "sha256", F.lit(1).alias("stored"))).selectExpr("id", "coalesce(heir, -1L) AS heir"),
        duck("""SELECT c.carrier_id AS id, coalesce((SELECT min(f.id) FROM files f WHERE f.project = c.project AND f.sha256 = c.sha256 AND f.id % 3 <> 0), -1) AS heir FROM contents c WHERE c.carrier_id % 3 = 0"""),
    ),
    "q17_purge": (_purged("nodes", lambda x: x.select("id")), duck(f"SELECT id FROM nodes WHERE trashed_at IS NULL OR trashed_at >= {T0 + 2_000_000}")),
    "a20_purge_report": (
        _purged("report", lambda x: x),
        _with(f"{_PURGE_DUCK} SELECT (SELECT count(*) FROM nodes WHERE trashed_at < {T0 + 2_000_000}) AS items, count(*) AS packs, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes_freed FROM dead"),
    ),
    "j10_dead_packs": (_purged("dead", lambda x: x.select("pack_id", "project")), _with(f"{_PURGE_DUCK} SELECT pack_id, project FROM dead")),
    "q17_contents_left": (
        _purged("contents", lambda x: x.select("project", "sha256", "refs")),
        _with(f"""{_PURGE_DUCK} SELECT c.project, c.sha256, (SELECT count(*) FROM stay n WHERE n.kind = 'f' AND n.project = c.project AND n.sha256 = c.sha256) AS refs FROM content_blobs c
            JOIN blobs b ON c.blob_id = b.blob_id AND c.project = b.project WHERE NOT EXISTS (SELECT 1 FROM dead x WHERE x.pack_id = b.pack_id AND x.project = b.project)"""),
    ),
    "q14_protect": (
        lambda s, d: transfers.protect(frame(s, d, "packs"), frame(s, d, "packs").selectExpr("pack_id", "project", "CASE pack_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'Repairable' END AS verify", "CASE WHEN pack_id % 3 = 2 THEN 'no space' END AS error")).select("pack_id", "project", "state", "outcome"),
        duck("""SELECT pack_id, project, CASE WHEN pack_id % 3 = 0 THEN 'protected' ELSE 'sealed' END AS state, ['protected', 'recovery data did not verify (Repairable); will retry', 'failed: no space'][pack_id % 3 + 1] AS outcome FROM packs WHERE state = 'sealed'"""),
    ),
    "q15_scrub": (
        lambda s, d: transfers.scrub(frame(s, d, "packs"), frame(s, d, "packs").selectExpr("pack_id", "project", "pack_id % 2 = 0 AS sound", "element_at(array('ok', 'repairable', 'unrepairable', 'no tool'), CAST(pack_id % 4 + 1 AS INT)) AS verify", "pack_id % 5 > 1 AS repaired"), T0 + 9_000_000),
        duck(f"""SELECT pack_id, project, coalesce(checked_at, 0) AS last, CASE WHEN state = 'sealed' AND pack_id % 2 = 0 THEN 'sealed' WHEN state = 'sealed' THEN 'damaged' WHEN pack_id % 4 = 0 OR pack_id % 4 = 1 AND pack_id % 5 > 1 THEN 'protected' WHEN pack_id % 4 IN (1, 2) THEN 'damaged' ELSE state END AS state,
            CASE WHEN state = 'sealed' AND pack_id % 2 = 0 THEN 'ok (no recovery data yet)' WHEN state = 'sealed' THEN 'DAMAGED, no recovery data' WHEN pack_id % 4 = 0 THEN 'ok' WHEN pack_id % 4 = 1 AND pack_id % 5 > 1 THEN 'damage found and repaired' WHEN pack_id % 4 = 1 THEN 'DAMAGED: repair failed'
            WHEN pack_id % 4 = 2 THEN 'DAMAGED beyond what recovery data can fix' ELSE 'check failed: no tool' END AS outcome FROM packs WHERE state IN ('sealed', 'protected', 'damaged') AND coalesce(checked_at, -1) < {T0 + 9_000_000}"""),
    ),
    "f16_daily_due": (
        lambda s, d: frame(s, d, "packs").select("pack_id", "project", changes.due(F.col("checked_at"), F.lit(T0 + 9_000_000)).alias("due")),
        duck(f"SELECT pack_id, project, coalesce({T0 + 9_000_000} - checked_at, 72000) >= 72000 AS due FROM packs"),
    ),
    "w05_snapshots_dropped": (
        lambda s, d: changes.snapshots_to_drop(frame(s, d, "files").selectExpr("date_format(timestamp_seconds(created), 'yyyy-MM-dd HH') AS day"), 2),
        duck("SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT strftime(to_timestamp(created) AT TIME ZONE 'UTC', '%Y-%m-%d %H') AS day FROM files)) WHERE k > 2"),
    ),
    "x12_sorted_view": (
        lambda s, d: changes.sorted_view(frame(s, d, "nodes").where("path LIKE '/Library/%'"), "size", True).limit(30).select("id"),
        duck("SELECT id FROM nodes WHERE path LIKE '/Library/%' ORDER BY kind <> 'd', size DESC, lower(name), name LIMIT 30"),
    ),
    "x10_deepest_first": (
        lambda s, d: frame(s, d, "nodes").where("kind = 'd' AND path IS NOT NULL").orderBy(F.desc(F.size(c.parts(F.col("path")))), "path").limit(10).select("path"),
        duck("SELECT path FROM nodes WHERE kind = 'd' AND path IS NOT NULL ORDER BY length(path) - length(replace(path, '/', '')) DESC, path = '/', path LIMIT 10"),
    ),
    "x05_by_id": (
        lambda s, d: frame(s, d, "packs").orderBy("pack_id", "project").limit(20).select("pack_id", "project", "bytes"),
        duck("SELECT pack_id, project, bytes FROM packs ORDER BY pack_id, project LIMIT 20"),
    ),
}
#: Moves that are tried, and why they may not be made.
_MOVES = (("/Library/fr", "/Library/fr/src1/x"), ("/Library/fr", "/Library/de"), ("/Library/xx", "/Library/y"), ("/Library/fr", "/nowhere/z"), ("/Library/fr", "/Library/new"), ("/", "/x"), ("/Library", "/.archive"))
