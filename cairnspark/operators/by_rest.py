"""What the other modules have inside larger queries, by itself; and what they give written anew for the other engine."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cairnspark.api import browse, changes, search, transfers
from cairnspark.functions import columns as c
from cairnspark.functions.search_language import filter_of, match_text, parse, size_of, start_of
from cairnspark.operators.by_source import _packed
from cairnspark.operators.by_transfer import _jobs
from cairnspark.operators.by_tree import QUERIES as _TREE
from cairnspark.sources import seekable, shared, tar, trees
from cairnspark.sources.fixtures import T0, duck, frame

_SIZES = ("2.5tb", "750kb", "12m", "64", "3gib", "1.2.3", "x", "9q")
_DATES = ("1999", "2024-02", "2024-02-30", "1800", "2024-13", "x")
_TOKENS = ("type:.PDF", "is:dirs", "is:folder", "before:2001", "size:<=2k", ">7", "ext:", "plain")
_QUERIES = ('alpha "two words" is:odd', "* (", 'say"so', "type:csv")


def _snapshots(s, d):
    """Catalog versions of four days, of which the newest two stay."""
    where = shared.work_dir(s, "snapshots")
    for day in ("2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"):
        trees.save_catalog({"projects": frame(s, d, "projects")}, f"{where}/{day}")
    days = s.createDataFrame([(x,) for x in os.listdir(where)], "day string")
    gone = [r.day for r in changes.snapshots_to_drop(days, 2).collect()]
    for day in gone:
        path = s._jvm.org.apache.hadoop.fs.Path(f"{where}/{day}")
        path.getFileSystem(s._jsc.hadoopConfiguration()).delete(path, True)
    left = sorted(os.listdir(where))
    return trees.open_catalog(s, f"{where}/{left[0]}")["projects"].select(F.lit(",".join(left)).alias("days"), "project")


def _replaced(s, d):
    """A document that is written twice: readers see the last, and nothing is left beside it."""
    where = shared.work_dir(s, "status")
    for k in (1, 2):
        shared.write_document(f"{where}/x/status.json", {"id": "x", "state": "running", "done": k})
    return trees.jobs(s, where).select("id", "done", F.lit(len(os.listdir(f"{where}/x"))).cast("long").alias("files"))


def _receipts(s, d):
    where = shared.work_dir(s, "receipts")
    for k in range(5):
        shared.write_document(f"{where}/part{k}.json", {"part": f"part{k}", "files": k, "bytes": 10 * k, "stored": k, "imported_at": T0})
    return trees.receipts(s, where).select("part", "files", "bytes", "stored")


QUERIES = {
    "c04_filters": (
        lambda s, d: s.createDataFrame([(t, str(filter_of(t))) for t in _TOKENS], "token string, filter string"),
        "SELECT unnest(['type:.PDF', 'is:dirs', 'is:folder', 'before:2001', 'size:<=2k', '>7', 'ext:', 'plain']) AS token, unnest(['(''ext'', ''pdf'')', 'None', '(''kind'', ''d'')', '(''before'', 978307200)', '(''size'', ''<='', 2000)', '(''size'', ''>'', 7)', 'None', 'None']) AS filter",
    ),
    "c05_sizes": (
        lambda s, d: s.createDataFrame([(t, size_of(t) if size_of(t) is not None else -1) for t in _SIZES], "text string, bytes bigint"),
        "SELECT unnest(['2.5tb', '750kb', '12m', '64', '3gib', '1.2.3', 'x', '9q']) AS text, unnest([2500000000000, 750000, 12000000, 64, 3000000000, -1, -1, -1]) AS bytes",
    ),
    "c06_dates": (
        lambda s, d: s.createDataFrame([(t, start_of(t) if start_of(t) is not None else -1) for t in _DATES], "text string, secs bigint"),
        "SELECT text, CAST(coalesce(epoch(moment), -1) AS BIGINT) AS secs FROM (VALUES ('1999', TIMESTAMP '1999-01-01'), ('2024-02', TIMESTAMP '2024-02-01'), ('2024-02-30', TIMESTAMP '2024-03-01'), ('1800', NULL), ('2024-13', NULL), ('x', NULL)) t(text, moment)",
    ),
    "c07_civil_days": (
        lambda s, d: frame(s, d, "files").select("id", c.civil_days(F.expr("mtime_ns div 1000000000 - id * 2000000")).alias("days")).withColumn("day", c.day_text(F.date_from_unix_date("days"))),
        duck("SELECT id, CAST(date_diff('day', DATE '1970-01-01', moment) AS INTEGER) AS days, strftime(moment, '%Y-%m-%d') AS day FROM (SELECT id, CAST(make_timestamp((mtime_ns // 1000000000 - id * 2000000) * 1000000) AS DATE) AS moment FROM files)"),
    ),
    "c23_solid_member": (
        lambda s, d: frame(s, d, "blobs").where("kind = 's'").selectExpr("blob_id", "project", "pack_id", "row_number() OVER (PARTITION BY project, pack_id ORDER BY blob_id) AS seq").select("blob_id", "project", c.solid_member(F.col("pack_id"), F.col("seq")).alias("member")),
        duck("SELECT blob_id, project, '.archive/solid-' || lpad(CAST(pack_id AS VARCHAR), 8, '0') || '-' || lpad(CAST((SELECT count(*) FROM blobs o WHERE o.kind = 's' AND o.project = b.project AND o.pack_id = b.pack_id AND o.blob_id <= b.blob_id) AS VARCHAR), 5, '0') || '.tar.zst' AS member FROM blobs b WHERE kind = 's'"),
    ),
    "c24_match_text": (
        lambda s, d: s.createDataFrame([(q, match_text(parse(q)) or "") for q in _QUERIES], "query string, match string"),
        "SELECT * FROM (VALUES ('alpha \"two words\" is:odd', '\"alpha\"* \"is:odd\"* \"two words\"'), ('* (', ''), ('say\"so', '\"say\"\"so\"*'), ('type:csv', '')) t(query, match)",
    ),
    "c25_like_literal": (
        lambda s, d: frame(s, d, "files").select("id", F.expr("'a_b%' || name || '\\\\'").alias("x")).withColumn("p", c.like_literal(F.col("x"))).select("id", F.expr("x LIKE p").alias("itself"), F.expr("replace(x, '_', 'z') LIKE p").alias("other")),
        duck("SELECT id, true AS itself, false AS other FROM files"),
    ),
    "f06_scan_filters": (
        lambda s, d: search.scan(frame(s, d, "files").withColumn("kind", F.lit("f")), "run type:gz >0.4k before:2024-01-20").select("id", "truncated"),
        duck("SELECT id, false AS truncated FROM files WHERE name LIKE '%run%' AND ends_with(name, '.gz') AND size > 400 AND mtime_ns < epoch_ns(TIMESTAMP '2024-01-20')"),
    ),
    "f07_folder_sizes": (
        lambda s, d: (lambda n: search.search(n, search.word_index(n), "is:folder size:>3000", None).select("path"))(frame(s, d, "nodes")),
        duck("SELECT path FROM nodes WHERE kind = 'd' AND path <> '/' AND size > 3000"),
    ),
    "j02_search_entries": (
        lambda s, d: (lambda n: browse.entries(search.search(n, search.word_index(n), "src1", None), frame(s, d, "projects")).select("id", "path", "is_project", "in_project"))(frame(s, d, "nodes")),
        duck("SELECT id, path, false AS is_project, true AS in_project FROM nodes WHERE path LIKE '/Library/%/src1%'"),
    ),
    "j07_locations": (
        lambda s, d: browse.subtree(frame(s, d, "nodes"), "/Library/de").join(frame(s, d, "content_blobs").select("project", "sha256", "blob_id"), ["project", "sha256"], "left").join(frame(s, d, "blobs").select("project", "blob_id", "pack_id"), ["project", "blob_id"], "left")
        .join(frame(s, d, "packs").select("project", "pack_id", "state"), ["project", "pack_id"], "left").select("id", F.coalesce("state", F.lit("")).alias("state")),
        duck("SELECT n.id, coalesce((SELECT p.state FROM pack_entries e JOIN packs p ON p.pack_id = e.pack_id AND p.project = e.project WHERE e.project = n.project AND e.sha256 = n.sha256 LIMIT 1), '') AS state FROM nodes n WHERE n.path = '/Library/de' OR n.path LIKE '/Library/de/%'"),
    ),
    "j11_indexed_only": (
        lambda s, d: (lambda n: n.join(search.word_index(n).select("id"), "id", "left_semi").select("id"))(frame(s, d, "nodes")),
        duck("SELECT id FROM nodes WHERE trashed_at IS NULL AND id > 2"),
    ),
    "k01_tar_contents": (
        lambda s, d: tar.read(s, _packed(s, d), content=True).where("path NOT LIKE '.archive/%'").select("path", F.sha2(seekable.read_range("content", F.lit(0), F.lit(100)), 256).alias("head")),
        "SELECT 'Library/' || lang || '/' || source || '/run' || doc_id || '_' || source || 'Sample' || ['.txt', '.csv', '.fastq.gz', '.pdf'][doc_id % 4 + 1] || '.zst' AS path, sha256((encode(coalesce(text, '')))[1:100]) AS head FROM (SELECT *, row_number() OVER (PARTITION BY lang, coalesce(text, '') ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    ),
    "k05_snapshots": (_snapshots, duck("SELECT '2024-03-03,2024-03-04' AS days, project FROM projects")),
    "k08_replaced_document": (_replaced, "SELECT 'x' AS id, 2::BIGINT AS done, 1::BIGINT AS files"),
    "s17_receipts": (_receipts, f"SELECT 'part' || k AS part, k AS files, 10 * k AS bytes, k AS stored FROM range(5) t(k) WHERE {T0} > 0"),
    "s21_rows_by_id": (
        lambda s, d: frame(s, d, "pack_entries").orderBy("id").limit(50).select("id", "path"),
        duck("SELECT id, path FROM pack_entries ORDER BY id LIMIT 50"),
    ),
    "a05_summary": (
        lambda s, d: _TREE["q05_info"][0](s, d).select("files", "folders", "original_bytes", "duplicate_bytes", "archived_at"),
        duck("""SELECT count(*) FILTER (WHERE kind = 'f') AS files, count(*) FILTER (WHERE kind = 'd') - 1 AS folders, CAST(sum(size) FILTER (WHERE kind = 'f') AS BIGINT) AS original_bytes, CAST(sum(size) FILTER (WHERE kind = 'f' AND EXISTS (SELECT 1 FROM nodes o
            WHERE o.project = n.project AND o.sha256 = n.sha256 AND o.path IS NOT NULL AND o.id < n.id)) AS BIGINT) AS duplicate_bytes, max(created) AS archived_at FROM nodes n WHERE path = '/Library/en' OR path LIKE '/Library/en/%'""").replace("CAST(sum(size) FILTER (WHERE kind = 'f' AND EXISTS", "CAST(coalesce(sum(size) FILTER (WHERE kind = 'f' AND EXISTS").replace("o.id < n.id)) AS BIGINT)", "o.id < n.id)), 0) AS BIGINT)"),
    ),
    "a22_dock": (
        lambda s, d: transfers.dock(_jobs(s, d)).select("moving", "paused", "failed"),
        duck("SELECT count(*) FILTER (WHERE event_id % 8 < 3) AS moving, count(*) FILTER (WHERE event_id % 8 = 3) AS paused, count(*) FILTER (WHERE event_id % 8 = 5) AS failed FROM job_events"),
    ),
    "x07_index_order": (
        lambda s, d: browse.index_lines(*(frame(s, d, t) for t in ("nodes", "content_blobs", "blobs", "packs")), frame(s, d, "pack_entries").groupBy("project", "sha256").agg(F.min_by("path", "id").alias("stored_path"))).limit(10).select("path"),
        duck("SELECT path FROM nodes WHERE kind = 'f' AND path IS NOT NULL ORDER BY path LIMIT 10"),
    ),
    "x11_parts_by_name": (
        lambda s, d: frame(s, d, "files").select(F.col("source").alias("part")).distinct().orderBy("part").limit(3),
        duck("SELECT DISTINCT source AS part FROM files ORDER BY source LIMIT 3"),
    ),
    "q31_trash_plan": (
        lambda s, d: (lambda n: changes.trash_plan(n.where("id % 5 = 0").select("path").union(s.sql("SELECT '/Library/nobody/x' UNION ALL SELECT '/home' UNION ALL SELECT '/home/me/.t/x/y'")), n.select("path"), "/home/me", "/home/me/.t")
                      .union(changes.trash_plan(n.where("id % 5 = 0 AND kind = 'f'").select("path"), n.select("path"), "/home/me", "/home/me/.t")))(frame(s, d, "nodes").where("path IS NOT NULL AND path <> '/' AND path <> '/Library'")),
        duck("""SELECT path, 'not moved' AS outcome FROM nodes WHERE path LIKE '/Library/%' AND id % 5 = 0 UNION ALL SELECT * FROM (VALUES ('/Library/nobody/x', 'missing'), ('/home', 'refused: that is the top level of a disk, not something to delete'), ('/home/me/.t/x/y', 'refused: it is in the trash already'))
            UNION ALL SELECT path, 'moved' FROM nodes WHERE path LIKE '/Library/%' AND id % 5 = 0 AND kind = 'f'"""),
    ),
    "q31_restore_plan": (
        lambda s, d: changes.untrash_plan(frame(s, d, "trashed").selectExpr("id", "CASE WHEN id % 2 = 0 THEN path ELSE '/Library/none/' || CAST(id AS STRING) END AS original").union(frame(s, d, "nodes").where("id = 3").select(F.lit(-1).cast("bigint"), "path")), frame(s, d, "nodes").where("path IS NOT NULL").select("path", "kind")),
        duck("SELECT id, CASE WHEN id % 2 = 0 THEN path ELSE '/Library/none/' || id END AS target, CASE WHEN id % 2 = 0 THEN 'restored' ELSE 'the folder it came from is gone' END AS outcome FROM trashed UNION ALL SELECT -1, path, 'already exists' FROM nodes WHERE id = 3"),
    ),
}
