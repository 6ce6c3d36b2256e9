"""Jobs, plans, commits, imports and rebuilding as registered queries, and what they give written anew for the other engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cairnspark.api import transfers
from cairnspark.plans.dialect import Spark
from cairnspark.sources.fixtures import T0, duck, frame, statement

NOW = T0 + 40 * 86_400
#: Jobs with all that the operators look at, in words of both engines.
_STATES = "['queued', 'running', 'waiting', 'paused', 'done', 'failed', 'cancelled', 'interrupted']"
_JOB = """SELECT 'job-' || CAST(event_id AS {t}) AS id, {states}[{at}] AS state, event_id % 3 = 0 AS locked, CASE WHEN event_id % 5 = 0 THEN 'relay' END AS relay, {now} - (event_id % 40) * 86400 - event_id % 29 AS updated,
    CASE WHEN event_id % 2 = 0 THEN 'send' ELSE 'retrieve' END AS direction, 'was' AS message, 's' || CAST(event_id % 4 AS {t}) AS server, event_id % 1000 AS done, 1000 + event_id % 7 AS total, event_id % 11 AS rate, event_id FROM job_events"""
_JOB_DUCK = _JOB.format(t="VARCHAR", states=_STATES, at="event_id % 8 + 1", now=NOW)
_JOB_SPARK = _JOB.format(t="STRING", states="array" + _STATES.replace("[", "(").replace("]", ")"), at="event_id % 8", now=NOW)


def _jobs(s, d):
    return s.sql(statement(Spark(d), _JOB_SPARK))


def _files(s, d, *columns):
    return frame(s, d, "files").selectExpr(*columns)


def _entries(s, d):
    """Manifest entries of packs with a twist: a part of the members is not named, and paths come again in later packs."""
    return s.sql(statement(Spark(d), _ENTRY.format(t="STRING")))


_ENTRY = """SELECT e.pack_id, e.project, e.id AS entry, CASE WHEN e.id % 9 = 0 THEN e.folder || '/same' ELSE e.path END AS path, 'f' AS kind, e.sha256, e.size, e.mtime_ns, CASE WHEN e.is_carrier THEN CAST(e.blob_id AS {t}) END AS member,
    CASE WHEN e.is_carrier THEN CAST(NULL AS {t}) ELSE s.path END AS same_as FROM pack_entries e JOIN files s ON s.id = e.carrier_id"""
_ENTRY_DUCK = _ENTRY.format(t="VARCHAR")
_PACKS = "SELECT pack_id, project, '/Library/' || project || CASE WHEN pack_id % 2 = 0 THEN '' ELSE '-moved' END AS project_path, state <> 'damaged' AS readable, state <> 'open' AS has_manifest FROM packs"


def _rebuilt(name: str, *columns):
    def run(s, d):
        members = frame(s, d, "blobs").selectExpr("pack_id", "project", "CAST(blob_id AS STRING) AS member")
        out = transfers.rebuild(_entries(s, d), members, s.sql(statement(Spark(d), _PACKS)))
        return out[name].select(*columns)

    return run


_REBUILT = f"""good AS ({_PACKS} WHERE state NOT IN ('damaged', 'open')), e AS (SELECT x.* FROM ({_ENTRY_DUCK}) x JOIN good g ON x.pack_id = g.pack_id AND x.project = g.project),
    r AS (SELECT e.*, EXISTS (SELECT 1 FROM e o WHERE o.project = e.project AND o.sha256 = e.sha256 AND o.member IS NOT NULL AND (o.pack_id, o.entry) <= (e.pack_id, e.entry)) AS held FROM e)"""


def _rebuild_duck(select: str) -> str:
    whole = duck("SELECT 1 FROM pack_entries, packs, files, blobs")
    return whole[: whole.rindex("SELECT 1 FROM pack_entries")].rstrip() + f", {_REBUILT} {select}"


def _parts(s, d):
    f = frame(s, d, "files").selectExpr("source AS part", "name AS path", "doc_id", "size", "sha256", "project")
    listed = f.where("doc_id % 37 <> 5")
    listed = listed.union(f.where("doc_id % 41 = 3")).select("part", F.expr("CASE WHEN doc_id % 53 = 7 THEN '../' || path ELSE path END").alias("path"))
    members = f.where("doc_id % 43 <> 1").select("part", "path")
    sums = f.groupBy("part").agg(F.min("sha256").alias("want"), F.when(F.max("doc_id") % 5 == 0, F.lit("x")).otherwise(F.min("sha256")).alias("got"))
    receipts = f.where("part LIKE '%3'").select("part").distinct()
    return f, receipts, listed, members, sums


_PARTS = """f AS (SELECT source AS part, name AS path, doc_id, sha256 FROM files), listed AS (SELECT part, CASE WHEN doc_id % 53 = 7 THEN '../' || path ELSE path END AS path FROM (SELECT * FROM f WHERE doc_id % 37 <> 5 UNION ALL SELECT * FROM f WHERE doc_id % 41 = 3)),
    members AS (SELECT part, path FROM f WHERE doc_id % 43 <> 1), problems AS (SELECT part, path, 'listed twice' AS problem FROM listed GROUP BY part, path HAVING count(*) > 1 UNION ALL
        SELECT part, path, 'unexpected member' FROM members m WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.part = m.part AND l.path = m.path)
        UNION ALL SELECT part, path, 'missing' FROM listed l WHERE NOT EXISTS (SELECT 1 FROM members m WHERE l.part = m.part AND l.path = m.path) GROUP BY part, path HAVING count(*) = 1)"""


def _parts_duck(select: str) -> str:
    whole = duck("SELECT 1 FROM files")
    return whole[: whole.rindex("SELECT 1 FROM files")].rstrip() + f", {_PARTS} {select}"


def _speed(window: float):
    def run(s, d):
        e = frame(s, d, "job_events").selectExpr("job_id", "event_id", "secs", "CAST(CASE WHEN event_id % 23 = 0 THEN 0 ELSE secs % 100000 + event_id END AS BIGINT) AS total")
        return transfers.speed(e, window).select("event_id", "rate")

    return run


#: The estimator replayed sample by sample: what each window would hold, from the row before.
_SPEED_DUCK = """SELECT event_id, CAST(CASE WHEN secs - base.t < 0.5 THEN 0 ELSE floor((total - base.d) / (secs - base.t)) END AS BIGINT) AS rate FROM (
    SELECT a.event_id, a.secs, a.total, coalesce((SELECT max_by({{'t': b.secs, 'd': b.total}}, b.place) FROM s b WHERE b.job_id = a.job_id AND b.run = a.run AND b.place <= a.place AND b.secs <= a.secs - {w}),
        (SELECT min_by({{'t': b.secs, 'd': b.total}}, b.place) FROM s b WHERE b.job_id = a.job_id AND b.run = a.run)) AS base FROM s a)"""


def _speed_duck(window: int) -> str:
    whole = duck("SELECT 1 FROM job_events")
    parts = """, e AS (SELECT job_id, event_id, secs, CASE WHEN event_id % 23 = 0 THEN 0 ELSE secs % 100000 + event_id END AS total, row_number() OVER (PARTITION BY job_id ORDER BY secs, event_id) AS place FROM job_events),
        s AS (SELECT a.*, (SELECT count(*) FROM e b JOIN e c ON c.job_id = b.job_id AND c.place = b.place - 1 WHERE b.job_id = a.job_id AND b.place <= a.place AND b.total < c.total) AS run FROM e a) """
    return whole[: whole.rindex("SELECT 1 FROM job_events")].rstrip() + parts + _SPEED_DUCK.format(w=window)


_RUN = """SELECT event_id AS id, event_id % 7 = 0 AS cancel_asked, event_id % 5 = 0 AS pause_asked, event_id % 11 = 0 AS stopped, event_id % 3 = 0 AS bad, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'lost the connection' ELSE 'disk full' END END AS error,
    CASE WHEN event_id % 13 = 0 THEN 'signed_out' ELSE 'other' END AS kind, event_id % 6 = 0 AS relay, event_id % 9 < 4 AS link, event_id % 8 AS drops, event_id % 16 < 8 AS link_up, event_id % 17 = 0 AS gave_up FROM job_events"""
_POLICIES = ("skip", "replace", "keep-both", "fail")


def _conflict(s, d):
    f = frame(s, d, "files").selectExpr("id", "CASE id % 13 WHEN 5 THEN folder WHEN 6 THEN path || '/inside' ELSE path END AS path", "sha256")
    n = frame(s, d, "dest").selectExpr("path", "'f' AS kind", "sha256").union(frame(s, d, "nodes").where("kind = 'd' AND path IS NOT NULL").select("path", "kind", "sha256"))
    mine = frame(s, d, "files").where("id % 4 = 0").select("path")
    return reduce(lambda a, b: a.union(b), [transfers.conflicts(f, n, p, mine).select("id", F.lit(p).alias("policy"), "decision") for p in _POLICIES])


_ITEMS = """SELECT source || '/' || name AS rel, 'f' AS kind, size, mtime_ns, sha256, id FROM files WHERE project = 'en' UNION ALL SELECT DISTINCT source, 'd', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS {t}), CAST(0 AS BIGINT) FROM files WHERE project = 'en'
    UNION ALL SELECT source || '/._' || name, 'f', size, mtime_ns, sha256, id FROM files WHERE project = 'en' AND id % 3 = 0 UNION ALL SELECT 'link' || CAST(id AS {t}), 'l', CAST(0 AS BIGINT), mtime_ns, CAST(NULL AS {t}), id FROM files WHERE project = 'en' AND id % 7 = 0"""
_THERE = """SELECT f.source || '/' || f.name AS rel, 'f' AS kind, x.size, x.mtime_ns, x.sha256 FROM dest x JOIN files f ON f.path = x.path WHERE f.project = 'en' AND f.source < 'src5' UNION ALL SELECT DISTINCT source, 'd', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS {t}) FROM files
    WHERE project = 'en' AND source < 'src5' UNION ALL SELECT DISTINCT source || ' (2)', 'd', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS {t}) FROM files WHERE project = 'en' AND source < 'src2'"""


def _copied(s, d):
    items, there = (s.sql(statement(Spark(d), q.format(t="STRING"))) for q in (_ITEMS, _THERE))
    return reduce(lambda a, b: a.union(b), [transfers.copy_plan(items, there, p, m).select(F.lit(f"{p} {m}").alias("how"), "rel", "target", "action") for p in _POLICIES[:3] for m in (False, True)])


def _views(s, d):
    return _jobs(s, d).select(F.concat(F.expr("CASE WHEN event_id % 3 = 0 THEN 'L' ELSE 'R:' END"), "id").alias("id"), "state", F.concat(F.lit("Title "), "id").alias("title"), F.when(F.col("event_id") % 3 != 0, F.col("server")).alias("server"))


QUERIES = {
    "f19_identity": (
        lambda s, d: frame(s, d, "files").join(frame(s, d, "dest").select("path", F.col("size").alias("s2"), F.col("mtime_ns").alias("m2")), "path").selectExpr("id", "named_struct('size', size, 'mtime_ns', mtime_ns, 'ctime_ns', id % 3, 'dev', 1, 'ino', IF(id % 4 = 0, NULL, id)) AS a", "named_struct('size', s2, 'mtime_ns', m2, 'ctime_ns', IF(id % 5 = 0, NULL, id % 3), 'dev', 1, 'ino', IF(id % 4 = 0, NULL, id)) AS b").select("id", transfers.same_file("a", "b").alias("same")),
        duck("SELECT f.id, f.size = x.size AND f.mtime_ns = x.mtime_ns AND f.id % 5 <> 0 AS same FROM files f JOIN dest x USING (path)"),
    ),
    "q21_copy_plan": (
        _copied,
        duck(f"""SELECT p || ' ' || m AS how, i.rel, CASE WHEN p = 'keep-both' AND n.rel IS NOT NULL THEN n.rel || CASE WHEN n.rel < 'src2' THEN ' (3)' ELSE ' (2)' END || substring(i.rel, length(n.rel) + 1) ELSE i.rel END AS target,
            CASE WHEN i.kind = 'l' THEN 'shortcut (symbolic link)' WHEN i.kind = 'd' THEN CASE WHEN n.rel IS NULL OR p = 'keep-both' THEN 'new folder' ELSE 'merge' END WHEN t.rel IS NULL OR p = 'keep-both' THEN 'copy'
            WHEN t.size = i.size AND t.mtime_ns = i.mtime_ns AND (m = 'False' OR t.sha256 = i.sha256) THEN 'already there' WHEN p = 'skip' THEN 'a different file is already there' ELSE 'replace' END AS action
            FROM ({_ITEMS.format(t='VARCHAR')}) i CROSS JOIN (SELECT unnest(['skip', 'replace', 'keep-both']) AS p) CROSS JOIN (SELECT unnest(['False', 'True']) AS m) LEFT JOIN ({_THERE.format(t='VARCHAR')}) t ON t.rel = i.rel
            LEFT JOIN (SELECT DISTINCT source AS rel FROM files WHERE project = 'en' AND source < 'src5') n ON n.rel = split_part(i.rel, '/', 1) WHERE i.rel NOT LIKE '%/.!_%' ESCAPE '!'"""),
    ),
    "q23_empty_dirs": (
        lambda s, d: transfers.emptied_folders(frame(s, d, "nodes").where("path IS NOT NULL AND path <> '/'").select(F.expr("CASE WHEN kind = 'f' AND (id % 3 = 0 OR path LIKE '/Library/fr/%') THEN regexp_replace(path, '/([^/]*)$', '/._$1') ELSE path END").alias("path"), "kind")),
        duck("SELECT d.path FROM nodes d WHERE d.kind = 'd' AND d.path <> '/' AND NOT EXISTS (SELECT 1 FROM nodes f WHERE f.kind = 'f' AND starts_with(f.path, d.path || '/') AND f.id % 3 <> 0 AND f.path NOT LIKE '/Library/fr/%')"),
    ),
    "q36_idle_seal": (
        lambda s, d: transfers.idle_packs(frame(s, d, "packs").withColumn("locked", F.col("pack_id") % 5 == 0).withColumnRenamed("checked_at", "touched"), NOW, NOW - T0 - 1200 * 7200).select("pack_id", "project"),
        duck("SELECT pack_id, project FROM packs WHERE state = 'open' AND pack_id % 5 <> 0 AND (pack_id % 3 = 0 OR pack_id <= 1200)"),
    ),
    "q39_leaving": (
        lambda s, d: transfers.leaving(_views(s, d)),
        duck(f"""SELECT 'transfer' AS kind, 'Title ' || id AS name, 1::BIGINT AS n FROM ({_JOB_DUCK}) WHERE event_id % 3 = 0 AND event_id % 8 < 3 UNION ALL SELECT 'paused', '', count(*) FROM ({_JOB_DUCK}) WHERE event_id % 3 = 0 AND state = 'paused'
            UNION ALL SELECT 'server', 's' || event_id % 4, count(*) FROM ({_JOB_DUCK}) WHERE event_id % 3 > 0 AND event_id % 8 < 3 GROUP BY event_id % 4"""),
    ),
    "q19_worker_report": (
        lambda s, d: (lambda p: transfers.worker_report(p, transfers.protect(p, p.selectExpr("pack_id", "project", "IF(pack_id % 2 = 0, 'ok', 'bad') AS verify", "CAST(NULL AS STRING) AS error")),
                                                        transfers.scrub(p.where("state <> 'sealed'"), p.selectExpr("pack_id", "project", "true AS sound", "IF(pack_id % 3 = 1, 'unrepairable', 'ok') AS verify", "false AS repaired"), T0 + 9_000_000)))(frame(s, d, "packs")),
        duck(f"""SELECT count(*) AS packs_total, count(*) FILTER (WHERE now = 'protected') AS packs_protected, count(*) FILTER (WHERE now IN ('open', 'sealed')) AS packs_pending, coalesce(string_agg(project || '/pack-' || lpad(CAST(pack_id AS VARCHAR), 8, '0'), ',' ORDER BY project, pack_id) FILTER (WHERE now = 'damaged'), '') AS packs_damaged
            FROM (SELECT *, CASE WHEN state = 'open' THEN 'open' WHEN state = 'sealed' THEN CASE WHEN pack_id % 2 = 0 THEN 'protected' ELSE 'sealed' END WHEN checked_at >= {T0 + 9_000_000} THEN state WHEN pack_id % 3 = 1 THEN 'damaged' ELSE 'protected' END AS now FROM packs)"""),
    ),
    "q25_job_list": (
        lambda s, d: transfers.job_list(_jobs(s, d), F.lit(NOW)).select("id", "state", F.length("message").cast("long").alias("said")),
        duck(f"""SELECT id, CASE WHEN state IN ('queued', 'running', 'waiting') AND NOT locked AND {NOW} - updated > 15 THEN 'interrupted' ELSE state END AS state, CAST(CASE WHEN state IN ('queued', 'running', 'waiting') AND NOT locked AND {NOW} - updated > 15 THEN 112 ELSE 3 END AS BIGINT) AS said
            FROM ({_JOB_DUCK}) j WHERE state NOT IN ('done', 'failed', 'cancelled') OR updated >= {NOW} - 2592000"""),
    ),
    "f18_restartable": (
        lambda s, d: transfers.restartable(transfers.job_list(_jobs(s, d), F.lit(NOW))).select("id"),
        duck(f"SELECT id FROM ({_JOB_DUCK}) WHERE event_id % 5 <> 0 AND (event_id % 8 = 7 OR event_id % 8 < 3 AND event_id % 3 <> 0 AND {NOW} - 15 > updated)"),
    ),
    "x08_newest_jobs": (
        lambda s, d: transfers.job_list(_jobs(s, d), F.lit(NOW)).limit(5).select("id"),
        duck(f"SELECT id FROM ({_JOB_DUCK}) WHERE NOT (event_id % 8 IN (4, 5, 6) AND updated < {NOW} - 2592000) ORDER BY id DESC LIMIT 5"),
    ),
    "q34_job_control": (
        lambda s, d: transfers.control(_jobs(s, d), _jobs(s, d).select("id", F.explode(F.array(*map(F.lit, ("cancel", "pause", "resume", "discard")))).alias("op")).union(s.sql("SELECT 'none', 'resume'"))).select("id", "op", "state", "outcome"),
        duck(f"""SELECT id, op, CASE WHEN outcome <> 'done' THEN state WHEN op = 'pause' THEN 'paused' WHEN op = 'resume' THEN 'queued' ELSE 'cancelled' END AS state, outcome FROM (SELECT id, op, state, CASE WHEN op = 'cancel' THEN CASE WHEN NOT locked AND state IN ('paused', 'interrupted', 'queued') THEN 'done' ELSE 'asked' END
            WHEN op = 'pause' THEN CASE WHEN NOT locked AND state IN ('interrupted', 'queued') THEN 'done' ELSE 'asked' END WHEN op = 'resume' THEN CASE WHEN NOT locked AND state IN ('paused', 'interrupted') THEN 'done' ELSE 'ignored' END
            ELSE CASE WHEN locked OR state IN ('queued', 'running', 'waiting') THEN 'stop the transfer first' ELSE 'done' END END AS outcome FROM ({_JOB_DUCK}) j, (SELECT unnest(['cancel', 'pause', 'resume', 'discard']) AS op) o)
            UNION ALL SELECT 'none', 'resume', NULL, 'not found'"""),
    ),
    "q35_job_outcome": (
        lambda s, d: transfers.run_outcome(s.sql(statement(Spark(d), _RUN))).select("id", "state"),
        duck(f"""SELECT id, CASE WHEN pause_asked AND NOT cancel_asked THEN 'paused' WHEN cancel_asked THEN 'cancelled' WHEN error IS NULL THEN CASE WHEN stopped THEN 'cancelled' WHEN bad THEN 'failed' ELSE 'done' END
            WHEN link AND (kind = 'signed_out' OR error = 'lost the connection') AND stopped THEN 'cancelled' WHEN link AND (kind = 'signed_out' OR error = 'lost the connection') AND NOT link_up AND NOT gave_up THEN 'waiting'
            WHEN link AND (kind = 'signed_out' OR error = 'lost the connection') AND link_up AND drops < 3 THEN 'running' WHEN kind = 'other' AND error = 'lost the connection' AND relay THEN 'interrupted' ELSE 'failed' END AS state FROM ({_RUN}) r"""),
    ),
    "w07_rate": (_speed(10_000), _speed_duck(10_000)),
    "q38_busy": (
        lambda s, d: transfers.busy_with(frame(s, d, "files").selectExpr("'v' || CAST(id AS STRING) AS id", "project AS place", "CASE WHEN id % 2 = 0 THEN 'running' ELSE 'done' END AS state", "array(path, folder || '/x/') AS sources"),
                                         frame(s, d, "files").where("id % 5 = 0").selectExpr("project AS place", "CASE WHEN id % 3 = 0 THEN folder || '/' WHEN id % 3 = 1 THEN path || '/in' ELSE folder || '/x' END AS source").distinct()).groupBy("source", "name").agg(F.count(F.lit(1)).alias("n")),
        duck("""SELECT source, regexp_extract(rtrim(source, '/'), '[^/]*$') AS name, count(*) AS n FROM (SELECT DISTINCT r.source, v.id FROM (SELECT DISTINCT project, CASE WHEN id % 3 = 0 THEN folder || '/' WHEN id % 3 = 1 THEN path || '/in' ELSE folder || '/x' END AS source FROM files WHERE id % 5 = 0) r
            JOIN (SELECT id, project, unnest([path, folder || '/x']) AS busy FROM files WHERE id % 2 = 0) v ON r.project = v.project AND (rtrim(r.source, '/') = v.busy OR starts_with(r.source, v.busy || '/') OR starts_with(v.busy, rtrim(r.source, '/') || '/'))) GROUP BY source"""),
    ),
    "q42_adopt": (
        lambda s, d: transfers.adopt(_jobs(s, d).where("event_id % 6 = 0").select(F.concat(F.lit("R:s1:"), "id").alias("id"), F.lit("old").alias("state"), "updated"), _jobs(s, d).select("id", "state", "updated"), _jobs(s, d).where("event_id % 7 = 0").select(F.concat(F.lit("R:s1:"), "id").alias("id")), "s1", F.lit(NOW)).select("id", "state"),
        duck(f"""SELECT 'R:s1:' || id AS id, CASE WHEN take THEN state ELSE 'old' END AS state FROM (SELECT *, event_id % 7 <> 0 AND (state IN ('queued', 'running', 'waiting', 'paused', 'interrupted') OR updated > {NOW} - 86400) AS take FROM ({_JOB_DUCK})) WHERE take OR event_id % 6 = 0"""),
    ),
    "j22_changed": (
        lambda s, d: transfers.changed_views(_jobs(s, d).select("id", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("state")).alias("state"), "done"), _jobs(s, d).where("event_id % 4 <> 1").select("id", "state", "done")).select("id", "state"),
        duck(f"SELECT id, state FROM ({_JOB_DUCK}) WHERE event_id % 4 <> 1 AND event_id % 3 = 0"),
    ),
    "j30_routes": (
        lambda s, d: transfers.kept_routes(_files(s, d, "id", "'s' || CAST(id % 6 AS STRING) AS from_id", "'s' || CAST(id % 5 AS STRING) AS to_id"), s.sql("SELECT 's' || CAST(id AS STRING) AS id, id IN (1, 3) AS temporary FROM range(5)")).select("id"),
        duck("SELECT id FROM files WHERE id % 6 NOT IN (1, 3, 5) AND id % 5 NOT IN (1, 3)"),
    ),
    "a29_server_names": (
        lambda s, d: transfers.server_names(_files(s, d, "id AS list_id", "array('s' || CAST(id % 6 AS STRING), 's1', 's1', 'zz') AS ids"), s.sql("SELECT 's' || CAST(id AS STRING) AS id, 'Name ' || CAST(9 - id AS STRING) AS name FROM range(5)")).select("list_id", F.array_join("names", ",").alias("names")),
        duck("SELECT id AS list_id, CASE id % 6 WHEN 5 THEN 'Name 8,Name 8' WHEN 0 THEN 'Name 8,Name 8,Name 9' WHEN 1 THEN 'Name 8,Name 8,Name 8' ELSE 'Name ' || (9 - id % 6) || ',Name 8,Name 8' END AS names FROM files"),
    ),
    "q43_abandon": (
        lambda s, d: transfers.abandon_plan(_files(s, d, "id", "CASE WHEN id % 3 = 0 THEN 'send' WHEN id % 3 = 1 THEN 'copy' ELSE 'retrieve' END AS direction", "folder || '/' AS dest", "array(path || '/', folder, path || '/in') AS created")),
        duck("SELECT id, unnest([path || '/', folder, path || '/in']) AS path, unnest(CASE WHEN id % 3 = 0 THEN ['trash', 'trash', 'trash'] ELSE ['remove', 'keep', 'keep'] END) AS action FROM files"),
    ),
    "q26_dock": (
        lambda s, d: transfers.dock(_jobs(s, d)).select("moving", "paused", "failed", "done", "total", "rate", "percent", F.round("seconds_left", 6).alias("seconds_left")),
        duck(f"""SELECT moving, paused, failed, done, total, rate, CAST(done * 100 // total AS BIGINT) AS percent, round((total - done) / rate, 6) AS seconds_left FROM (SELECT count(*) FILTER (WHERE event_id % 8 < 3) AS moving, count(*) FILTER (WHERE state = 'paused') AS paused, count(*) FILTER (WHERE state = 'failed') AS failed,
            CAST(sum(done) FILTER (WHERE event_id % 8 < 3) AS BIGINT) AS done, CAST(sum(total) FILTER (WHERE event_id % 8 < 3) AS BIGINT) AS total, CAST(sum(rate) FILTER (WHERE event_id % 8 < 3) AS BIGINT) AS rate FROM ({_JOB_DUCK}))"""),
    ),
    "q10_conflicts": (
        _conflict,
        duck("""SELECT id, policy, CASE WHEN id % 13 = 6 AND has THEN 'not a folder' WHEN id % 13 = 6 THEN 'new' WHEN id % 13 = 5 THEN CASE policy WHEN 'skip' THEN 'skip' WHEN 'replace' THEN 'is a folder' WHEN 'keep-both' THEN 'keep both' ELSE 'already exists' END WHEN NOT has THEN 'new' WHEN same THEN 'identical'
            ELSE CASE policy WHEN 'skip' THEN 'skip' WHEN 'replace' THEN CASE WHEN id % 4 = 0 THEN 'replace' ELSE 'frozen' END WHEN 'keep-both' THEN 'keep both' ELSE 'already exists' END END AS decision
            FROM (SELECT f.id, x.path IS NOT NULL AS has, x.sha256 = f.sha256 AS same FROM files f LEFT JOIN dest x USING (path)) a, (SELECT unnest(['skip', 'replace', 'keep-both', 'fail']) AS policy) b"""),
    ),
    "f27_stored_by_job": (
        lambda s, d: transfers.stored_by_job(frame(s, d, "files"), frame(s, d, "content_blobs").join(frame(s, d, "blobs").select("blob_id", "project", "pack_id"), ["blob_id", "project"]), frame(s, d, "packs").withColumn("job", F.col("pack_id") % 2), F.col("job") == 0).select("id"),
        duck("SELECT e.id FROM pack_entries e JOIN packs p ON e.pack_id = p.pack_id AND e.project = p.project WHERE p.state = 'open' AND p.pack_id % 2 = 0"),
    ),
    "q12_commit": (
        lambda s, d: transfers.commit(_files(s, d, "source AS scope", "id AS seq", "sha256 AS digest", "size"), _files(s, d, "source AS scope", "id AS seq", "CASE WHEN id % 31 = 4 THEN 'x' ELSE sha256 END AS digest", "CASE WHEN id % 37 = 4 THEN size + 1 ELSE size END AS size", "CASE WHEN id % 41 = 4 THEN 'read error' END AS error").where("seq % 53 <> 9")),
        duck("""SELECT scope, id AS seq, CASE WHEN id < coalesce(first, 9223372036854775807) THEN 'committed' ELSE 'sent again' END AS state, CASE WHEN id > first THEN 'written after a file whose check failed' WHEN id = first THEN CASE WHEN id % 53 = 9 THEN 'the read-back check stopped unexpectedly' WHEN id % 41 = 4 THEN 'read error'
            WHEN id % 31 = 4 THEN 'checksum mismatch after writing' ELSE 'size changed while sending' END END AS why FROM (SELECT source AS scope, id, min(CASE WHEN id % 53 = 9 OR id % 41 = 4 OR id % 31 = 4 OR id % 37 = 4 THEN id END) OVER (PARTITION BY source) AS first FROM files)"""),
    ),
    "j19_block_check": (
        lambda s, d: (lambda f: transfers.check_block(f.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("path", "size", "sha256"))).alias("members")), f.where("block <> '/Library/en/src1' OR name NOT LIKE '%8%'").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("path", F.when(F.col("id") % 29 == 0, -1).otherwise(F.col("size")).alias("size"), "sha256"))).alias("members"))))(frame(s, d, "files").withColumn("block", F.col("folder"))),
        duck("SELECT folder AS block, count(*) FILTER (WHERE id % 29 = 0 OR folder = '/Library/en/src1' AND name LIKE '%8%') = 0 AS ok FROM files GROUP BY folder"),
    ),
    "j16_manifest_members": (
        lambda s, d: transfers.manifest_members(_entries(s, d), frame(s, d, "blobs").where("blob_id % 7 <> 2").selectExpr("pack_id", "project", "CAST(blob_id AS STRING) AS member")).select("entry", "found"),
        duck("SELECT id AS entry, NOT (is_carrier AND blob_id % 7 = 2) AS found FROM pack_entries"),
    ),
    "j18_reconcile_parts": (lambda s, d: transfers.reconcile(*_parts(s, d)[2:4]), _parts_duck("SELECT part, path, problem FROM problems")),
    "q24_import_plan": (
        lambda s, d: (lambda p: transfers.import_plan(p[0], p[1], p[2], p[3], p[4]))(_parts(s, d)),
        _parts_duck("""SELECT part, CASE WHEN part LIKE '%3' THEN 'imported before' WHEN why IS NULL THEN 'import' ELSE 'refused' END AS state, CASE WHEN part NOT LIKE '%3' THEN why END AS why FROM (SELECT part, CASE WHEN max(doc_id) % 5 = 0 THEN 'doesn''t match its checksum'
            WHEN EXISTS (SELECT 1 FROM listed l WHERE l.part = f.part AND l.path LIKE '../%') THEN 'unsafe path: ' || (SELECT min(path) FROM listed l WHERE l.part = f.part AND l.path LIKE '../%')
            ELSE (SELECT min_by(path || ': ' || problem, (path, problem)) FROM problems p WHERE p.part = f.part) END AS why FROM f GROUP BY part)"""),
    ),
    "k09_receipts": (
        lambda s, d: (lambda f: transfers.import_receipts(f.select("part").distinct().withColumn("state", F.when(F.col("part").endswith("1"), "refused").otherwise("import")), f.withColumn("outcome", F.expr("CASE WHEN doc_id % 60 = 2 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'stored' WHEN doc_id % 3 = 1 THEN 'identical' ELSE 'deduplicated' END")), T0))(_parts(s, d)[0]),
        duck(f"""SELECT source AS part, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE doc_id % 3 = 0) AS stored, count(*) FILTER (WHERE doc_id % 3 = 2) AS deduplicated, count(*) FILTER (WHERE doc_id % 3 = 1) AS identical, CAST({T0} AS BIGINT) AS imported_at
            FROM files WHERE source NOT LIKE '%1' GROUP BY source HAVING count(*) FILTER (WHERE doc_id % 60 = 2) = 0"""),
    ),
    "q18_rebuild": (_rebuilt("files", "path", "project", "sha256", "size", "mtime_ns"), _rebuild_duck("SELECT path, project, sha256, size, mtime_ns FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pack_id DESC, entry DESC) AS k FROM r WHERE held) WHERE k = 1")),
    "q18_missing": (_rebuilt("missing", "path", "pack_id", "project"), _rebuild_duck("SELECT path, pack_id, project FROM r WHERE NOT held")),
    "q18_skipped": (_rebuilt("skipped", "pack_id", "project", "why"), duck("SELECT pack_id, project, CASE WHEN state = 'damaged' THEN 'unreadable' ELSE 'no manifest (the pack was never sealed)' END AS why FROM packs WHERE state IN ('damaged', 'open')")),
    "q18_projects": (_rebuilt("projects", "project", "path"), duck("SELECT project, '/Library/' || project || CASE WHEN max(pack_id) % 2 = 0 THEN '' ELSE '-moved' END AS path FROM packs WHERE state IN ('sealed', 'protected') GROUP BY project")),
    "q18_folders": (
        _rebuilt("folders", "path"),
        _rebuild_duck("SELECT DISTINCT unnest(['/Library', '/Library/' || string_split(path, '/')[3], regexp_extract(path, '^(.*)/[^/]*$', 1)]) AS path FROM r WHERE held"),
    ),
    "q32_recovery": (
        lambda s, d: transfers.recovery(_entries(s, d)).select("path", "pack_id", "how"),
        _rebuild_duck(f"""SELECT path, pack_id, how FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY how = 'not there', pack_id DESC, how = 'unpacked') AS k FROM (SELECT a.path, a.pack_id, CASE WHEN a.member IS NOT NULL THEN 'unpacked'
            WHEN EXISTS (SELECT 1 FROM ({_ENTRY_DUCK}) b WHERE b.member IS NOT NULL AND b.path = a.same_as AND b.pack_id <= a.pack_id) THEN 'copied' ELSE 'not there' END AS how FROM ({_ENTRY_DUCK}) a)) WHERE k = 1"""),
    ),
    "j23_resend": (
        lambda s, d: transfers.resend(_files(s, d, "path", "id AS seq", "'why ' || CAST(id % 3 AS STRING) AS reason").where("seq % 10 = 1").union(_files(s, d, "path", "id + 1", "'later'").where("path LIKE '%1_src%'")), _files(s, d, "id", "path")).select("id", "reason"),
        duck("SELECT id, CASE WHEN id % 10 = 1 THEN 'why ' || id % 3 ELSE 'later' END AS reason FROM files WHERE id % 10 = 1 OR regexp_matches(path, '1.src')"),
    ),
    "a17_links_by_project": (
        lambda s, d: transfers.links_by_project(_files(s, d, "project", "id AS seq").where("seq % 3 = 1")),
        duck("SELECT project, count(*) AS n, min(id) AS first FROM files WHERE id % 3 = 1 GROUP BY project"),
    ),
    "a26_timing": (
        lambda s, d: transfers.timing(_files(s, d, "1 AS files", "size AS bytes", "id % 5 AS receive", "id % 3 AS check", "id % 7 AS wait", "id % 2 AS commit")),
        duck("SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(id % 5) AS BIGINT) AS receive, CAST(sum(id % 3) AS BIGINT) AS \"check\", CAST(sum(id % 7) AS BIGINT) AS wait, CAST(sum(id % 2) AS BIGINT) AS \"commit\" FROM files"),
    ),
    "k10_timing_line": (
        lambda s, d: transfers.timing_line(transfers.timing(_files(s, d, "1 AS files", "99999L AS bytes", "1 AS receive", "2 AS check", "0 AS wait", "1 AS commit").limit(3))),
        "SELECT '3 files, 300 KB, receive 3.0 s, check 6.0 s, wait 0.0 s, commit 3.0 s' AS line",
    ),
    "a25_partial_files": (
        lambda s, d: transfers.partial_files(_files(s, d, "substring(folder, 10) || '/' || name || CASE WHEN id % 4 = 0 THEN '.partial' ELSE '' END AS path")),
        duck("SELECT project AS part, count(*) AS n FROM files WHERE id % 4 = 0 GROUP BY project"),
    ),
    "a21_copy_totals": (
        lambda s, d: frame(s, d, "files").groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.countDistinct("folder").alias("folders")),
        duck("SELECT project, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT folder) AS folders FROM files GROUP BY project"),
    ),
    "q30_frames": (
        lambda s, d: transfers.frame_plan(frame(s, d, "content_blobs").selectExpr("sha256 || project AS id", "concat(project, CAST(blob_id AS STRING)) AS blob", "blob_off AS off", "size"),
                                          frame(s, d, "sized_blobs").selectExpr("concat(project, CAST(blob_id AS STRING)) AS blob", "raw_len", "explode(sequence(0, CAST((greatest(raw_len, 1) - 1) div 700 AS INT))) AS frame").selectExpr("blob", "frame", "frame * 300L AS c_off", "70000L AS c_len", "frame * 700L AS d_off", "least(700L, raw_len - frame * 700L) AS d_len")).select("id", "first_frame", "last_frame", "skip", "sent", "shortcut"),
        duck("""SELECT sha256 || project AS id, CAST(blob_off // 700 AS INT) AS first_frame, CAST((blob_off + size - 1) // 700 AS INT) AS last_frame, blob_off % 700 AS skip, ((blob_off + size - 1) // 700 - blob_off // 700 + 1) * 70000 AS sent,
            ((blob_off + size - 1) // 700 - blob_off // 700 + 1) * 70000 > 2 * size + 65536 AS shortcut FROM content_blobs WHERE size > 0"""),
    ),
}
