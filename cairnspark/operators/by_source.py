"""Sources, sinks and streams as registered queries: what is written is read back and held against the tables it came from."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile

from pyspark.sql import functions as F

from cairnspark.api import browse, transfers
from cairnspark.operators.by_transfer import _speed_duck
from cairnspark.sources import seekable, shared, tar, trees
from cairnspark.sources.fixtures import T0, duck, frame
from cairnspark.streaming import jobs as streams

_DOCS = "documents.parquet"


def _texts(s, d):
    return s.read.parquet(f"{d}/{_DOCS}").selectExpr("doc_id + 1000 AS id", "encode(coalesce(text, ''), 'utf-8') AS data")


def _packed(s, d):
    """The catalog's carriers as tars, one a pack, each text a member of its own, then sealed; the folder they lie in."""
    where = shared.work_dir(s, "packs")
    e = frame(s, d, "pack_entries").withColumn("pack", F.format_string("%s/pack-%08d.tar", "project", "pack_id"))
    # mtime_ns anew, from seconds: the relation's own is a bigint, and from doc_id 2,088,696 on it overflows
    e = e.withColumn("mtime", F.lit(T0) + (F.col("id") - 1000) * 3600).withColumn("mtime_ns", F.col("mtime").cast("decimal(19,0)") * F.lit(1_000_000_000))
    e = e.withColumn("member", F.when(F.col("is_carrier"), F.concat(F.substring("path", 2, 10_000), F.lit(".zst"))))
    files = e.where("is_carrier").join(_texts(s, d), "id").select("pack", F.col("id").alias("seq"), F.col("member").alias("path"), F.lit("f").alias("kind"), "mtime", F.lit(420).alias("mode"),
                                                                  F.lit(None).cast("string").alias("target"), seekable.compressed(F.col("data"), 1000, 3).alias("content"))
    first = e.where("is_carrier").select("project", "sha256", F.col("path").alias("stored_path"))
    told = e.join(first, ["project", "sha256"]).select(
        "pack", "pack_id", F.col("id").alias("seq"), "project", F.concat(F.lit("/Library/"), "project").alias("project_path"), "path", F.lit("f").alias("kind"), "sha256", "size", "mtime_ns", F.lit(420).alias("mode"), "member",
        F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("string").alias("target"), F.when(~F.col("is_carrier"), F.col("stored_path")).alias("same_as"),
    )
    tar.write(files.unionByName(tar.seal(told, T0)), where)
    return where


def _tree(s):
    """A small tree with junk, links, hidden and excluded names, and odd characters."""
    top = shared.work_dir(s, "tree")
    for path, size in (("a/one.txt", 10), ("a/.DS_Store", 5), ("a/deep/two words.csv", 2000), ("b/._junk", 1), ("b/résumé.pdf", 30), ("b/skip.tmp", 7), (".hidden/x.txt", 3), ("top.md", 12), ("Thumbs.db", 4)):
        os.makedirs(os.path.dirname(os.path.join(top, path)), exist_ok=True)
        with open(os.path.join(top, path), "wb") as f:
            f.write(b"x" * size)
    os.makedirs(os.path.join(top, "empty"))
    os.symlink("a/one.txt", os.path.join(top, "link"))
    return top


def _documents(s, d):
    """Job, trash and configuration documents as files."""
    top = shared.work_dir(s, "documents")
    shared.write_document(f"{top}/archive.json", {"format": 1, "archive_id": "abc", "created": T0, "pack_target_bytes": 34359738368, "par2_redundancy_percent": 10, "trash_days": 30})
    for k in range(12):
        shared.write_document(f"{top}/jobs/j{k:02d}/status.json", {"id": f"j{k:02d}", "state": ["running", "done", "paused"][k % 3], "updated": T0 + k, "locked": k % 2 == 0, "created": ["/x"] * (k % 3), "unknown": 1})
        shared.write_document(f"{top}/trash/t{k:02d}.json", {"id": f"t{k:02d}", "name": f"n{k}", "original": f"/o/n{k}", "stored": f"/t/t{k:02d}/n{k}", "kind": "file", "size": k, "trashed_at": T0 + k % 5})
    os.makedirs(f"{top}/jobs/broken")
    with open(f"{top}/jobs/broken/status.json", "w") as f:
        f.write("{not json")
    shared.write_document(f"{top}/maintenance.json", {"started": T0, "finished": T0 + 60, "protected": ["p1"], "packs_total": 3, "packs_damaged": [], "errors": ["e"]})
    return top


def _catalog(s, d):
    where = shared.work_dir(s, "catalog")
    tables = {t: frame(s, d, t) for t in ("nodes", "projects", "packs")}
    trees.save_catalog(tables, where)
    return trees.open_catalog(s, where)["nodes"].select("id", "path", "kind", "size")


def _part_file(s, d):
    """A file that arrives in pieces, with a broken transfer in the middle and a wrong digest once."""
    where, data = shared.work_dir(s, "parts"), bytes(range(256)) * 40
    p = shared.PartFile(f"{where}/whole.bin")
    p.write(0, data[:3000])
    p = shared.PartFile(f"{where}/whole.bin")  # after a break
    at = p.have()
    p.write(at, b"wrong")
    p.write(2000, data[2000:])  # goes on from an earlier place
    ok = p.finish(hashlib.sha256(data).hexdigest())
    bad = shared.PartFile(f"{where}/other.bin")
    bad.write(0, b"abc")
    refused = bad.finish("0" * 64)
    with open(f"{where}/whole.bin", "rb") as f:
        same = f.read() == data
    return s.createDataFrame([(at, ok, refused, same, bad.have())], "resumed bigint, ok boolean, wrong boolean, same boolean, left bigint")


def _append(s, d):
    """Members at the end of an open pack; one that fails leaves it as it was."""
    path = f"{shared.work_dir(s, 'open')}/pack-00000001.tar"
    tar.append(path, [("a", b"1" * 10), ("b/" + "x" * 200, b"2" * 1000)])
    try:
        tar.append(path, [("c", b"3"), ("d", None)])
    except TypeError:
        pass
    tar.append(path, [("e", b"5" * 5)])
    return tar.read(s, path, content=True).select("seq", "path", "size", F.sha2("content", 256).alias("sha256"))


def _damaged(s, d):
    """Packs of which one is cut and one is not sealed: both are told, the others are read."""
    where = _packed(s, d)
    found = tar.pack_files(where)
    with open(found[0][1], "r+b") as f:
        f.write(b"no tar header" * 60)
    tar.append(f"{where}/pack-99999999.tar", [("x", b"y")])
    return tar.manifests(s, where).select("readable", "has_manifest").groupBy("readable", "has_manifest").agg(F.count(F.lit(1)).alias("n"))


def _stream(s, d, make, columns: str):
    """Job events as JSON files, some a step, through a stream to its end."""
    where = shared.work_dir(s, "stream")
    e = frame(s, d, "job_events").selectExpr("job_id", "event_id", "timestamp_seconds(secs) AS ts", "state", "CAST(CASE WHEN event_id % 23 = 0 THEN 0 ELSE secs % 100000 + event_id END AS BIGINT) AS total")
    rows = e.orderBy("ts", "event_id").coalesce(1)
    rows.write.mode("overwrite").json(f"{where}/in")
    return streams.collected(make(streams.events(s, f"{where}/in", 2)), s, where).selectExpr(*columns.split(", "))


def _bundle(s, d):
    """An old bundle: a tar that holds a tar, a manifest and a checksum; its files held against its manifest."""
    where = shared.work_dir(s, "bundle")
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        for name in ("run/a.txt.zst", "run/b.txt.zst", "run/extra.zst"):
            m = tarfile.TarInfo(name)
            m.size = 3
            t.addfile(m, io.BytesIO(b"abc"))
    raw = inner.getvalue()
    manifest = {"name": "part1", "source_name": "run", "files": [{"path": "a.txt", "size": 3}, {"path": "b.txt", "size": 3}, {"path": "gone.txt", "size": 1}], "directories": []}
    tar.append(f"{where}/part1.tar", [("part1.tar", raw), ("MANIFEST.json", json.dumps(manifest).encode()), ("part1.tar.sha256", (hashlib.sha256(raw).hexdigest() + "  part1.tar\n").encode())])
    outer = {r.path: r.content for r in tar.read(s, f"{where}/part1.tar", content=True).collect()}
    told = json.loads(bytes(outer["MANIFEST.json"]))
    expected = s.createDataFrame([("part1", f"{told['source_name']}/{f['path']}.zst") for f in told["files"]], "part string, path string")
    held = s.createDataFrame([("part1", m[1]) for m in tar.nested(bytes(outer["part1.tar"]))], "part string, path string")
    return transfers.reconcile(expected, held)


QUERIES = {
    "s01_open_catalog": (_catalog, duck("SELECT id, path, kind, size FROM nodes")),
    "s02_config": (
        lambda s, d: s.createDataFrame([(lambda c: (c["archive_id"], c["trash_days"], c["pack_target_bytes"]))(trees.open_archive(s, _documents(s, d)))], "archive_id string, trash_days int, pack_target_bytes bigint"),
        "SELECT 'abc' AS archive_id, CAST(30 AS INTEGER) AS trash_days, 34359738368 AS pack_target_bytes",
    ),
    "s03_tar_members": (
        lambda s, d: tar.read(s, _packed(s, d)).where("path NOT LIKE '.archive/%'").select("pack", "path", "kind", "mtime", "mode"),
        duck("SELECT 'pack-' || lpad(CAST(pack_id AS VARCHAR), 8, '0') || '.tar' AS pack, substring(path, 2) || '.zst' AS path, 'f' AS kind, mtime_ns // 1000000000 AS mtime, CAST(420 AS INTEGER) AS mode FROM pack_entries WHERE is_carrier"),
    ),
    "s04_seek_table": (
        lambda s, d: seekable.frames(_texts(s, d).select("id", seekable.compressed(F.col("data"), 1000, 1).alias("stream"))).select("id", "frame", "d_off", "d_len"),
        duck("SELECT id, CAST(k AS INTEGER) AS frame, k * 1000 AS d_off, least(1000, size - k * 1000) AS d_len FROM (SELECT id, size, unnest(range(0, greatest((size + 999) // 1000, 1))) AS k FROM files)"),
    ),
    "s05_range_read": (
        lambda s, d: _texts(s, d).select("id", "data", seekable.compressed(F.col("data"), 700, 1).alias("stream")).select("id", F.sha2(seekable.read_range("stream", F.lit(650), F.lit(900)), 256).alias("sha256")),
        "SELECT doc_id + 1000 AS id, sha256((encode(coalesce(text, '')))[651:1550]) AS sha256 FROM documents",
    ),
    "k06_verified": (
        lambda s, d: tar.read(s, _packed(s, d), content=True).where("path NOT LIKE '.archive/%'").select("path", F.sha2(seekable.read_range("content", F.lit(0), F.lit(1 << 30)), 256).alias("sha256")),
        duck("SELECT substring(path, 2) || '.zst' AS path, sha256 FROM pack_entries WHERE is_carrier"),
    ),
    "s14_pack_files": (
        lambda s, d: s.createDataFrame(tar.pack_files(_packed(s, d)), "pack_id bigint, path string").selectExpr("pack_id", "element_at(split(path, '/'), -2) AS project"),
        duck("SELECT DISTINCT pack_id, project FROM pack_entries"),
    ),
    "s15_manifest_entries": (
        lambda s, d: tar.entries(tar.manifests(s, _packed(s, d))).selectExpr("pack_id", "project", "path", "sha256", "size", "mtime_ns", "coalesce(member, '') AS member", "coalesce(same_as, '') AS same_as"),
        duck("SELECT e.pack_id, e.project, e.path, e.sha256, e.size, e.mtime_ns, CASE WHEN e.is_carrier THEN substring(e.path, 2) || '.zst' ELSE '' END AS member, CASE WHEN e.is_carrier THEN '' ELSE f.path END AS same_as FROM pack_entries e JOIN files f ON f.id = e.carrier_id"),
    ),
    "k03_duplicates": (
        lambda s, d: tar.read(s, _packed(s, d), only=[tar.DUPLICATES]).where(F.col("path") == tar.DUPLICATES).select(F.explode(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n")).alias("line")),
        duck("SELECT e.path || chr(9) || f.path || chr(9) || e.sha256 || chr(9) || strftime(make_timestamp(e.mtime_ns // 1000), '%Y%m%d%H%M.%S') AS line FROM pack_entries e JOIN files f ON f.id = e.carrier_id WHERE NOT e.is_carrier"),
    ),
    "q18_rebuild_tars": (
        lambda s, d: (lambda where: (lambda m: transfers.rebuild(tar.entries(m), tar.read(s, where).selectExpr("CAST(regexp_extract(pack, 'pack-([0-9]+)', 1) AS BIGINT) AS pack_id", "split(path, '/')[1] AS project", "path AS member"), m)["files"])(tar.manifests(s, where)))(_packed(s, d)).select("path", "sha256", "size", "mtime_ns"),
        duck("SELECT e.path, e.sha256, e.size, e.mtime_ns FROM pack_entries e JOIN pack_entries c ON c.id = e.carrier_id WHERE c.pack_id <= e.pack_id"),
    ),
    "s03_damaged_packs": (
        _damaged,
        duck("SELECT unnest([true, false, true]) AS readable, unnest([true, false, false]) AS has_manifest, unnest([(SELECT count(DISTINCT (pack_id, project)) FROM pack_entries) - 1, 1, 1]) AS n"),
    ),
    "k02_append": (
        _append,
        "SELECT CAST(seq AS INTEGER) AS seq, path, size, sha256(body) AS sha256 FROM (VALUES (0, 'a', 10, repeat('1', 10)), (1, 'b/' || repeat('x', 200), 1000, repeat('2', 1000)), (2, 'e', 5, repeat('5', 5))) t(seq, path, size, body)",
    ),
    "k07_part_file": (_part_file, "SELECT 3000::BIGINT AS resumed, true AS ok, false AS wrong, true AS same, 0::BIGINT AS \"left\""),
    "s16_bundle": (_bundle, "SELECT 'part1' AS part, unnest(['run/extra.zst', 'run/gone.txt.zst']) AS path, unnest(['unexpected member', 'missing']) AS problem"),
    "s06_scan": (
        lambda s, d: trees.scan(s, _tree(s), ("*.tmp",))[0].select("path", "kind", "size", F.coalesce("target", F.lit("")).alias("target")),
        "SELECT * FROM (VALUES ('a', 'd', 0, ''), ('a/one.txt', 'f', 10, ''), ('a/deep', 'd', 0, ''), ('a/deep/two words.csv', 'f', 2000, ''), ('b', 'd', 0, ''), ('b/résumé.pdf', 'f', 30, ''), ('.hidden', 'd', 0, ''), ('.hidden/x.txt', 'f', 3, ''), ('top.md', 'f', 12, ''), ('empty', 'd', 0, ''), ('link', 'l', 0, 'a/one.txt')) t(path, kind, size, target)",
    ),
    "s07_walk": (lambda s, d: trees.walk(s, _tree(s)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "SELECT * FROM (VALUES ('d', 5, 0), ('f', 9, 2072), ('l', 1, 0)) t(kind, n, bytes)"),
    "s08_list_one": (lambda s, d: trees.list_one(s, _tree(s)).select("name", "kind"), "SELECT * FROM (VALUES ('a', 'd'), ('b', 'd'), ('empty', 'd'), ('link', 'l'), ('top.md', 'f')) t(name, kind)"),
    "s18_jobs": (
        lambda s, d: trees.jobs(s, f"{_documents(s, d)}/jobs").select("id", "state", "updated", F.size("created").cast("long").alias("n")),
        f"SELECT 'j' || lpad(CAST(k AS VARCHAR), 2, '0') AS id, ['running', 'done', 'paused'][k % 3 + 1] AS state, {T0} + k AS updated, k % 3 AS n FROM range(12) t(k)",
    ),
    "s19_trash_notes": (
        lambda s, d: trees.trash_notes(s, f"{_documents(s, d)}/trash", s.sql("SELECT '/t/t' || lpad(CAST(id AS STRING), 2, '0') || '/n' || CAST(id AS STRING) AS path FROM range(12) WHERE id % 4 <> 1")).select("id", "original", "trashed_at"),
        f"SELECT 't' || lpad(CAST(k AS VARCHAR), 2, '0') AS id, '/o/n' || k AS original, {T0} + k % 5 AS trashed_at FROM range(12) t(k) WHERE k % 4 <> 1",
    ),
    "s20_last_report": (
        lambda s, d: trees.last_report(s, f"{_documents(s, d)}/maintenance.json").select("started", "finished", F.array_join("protected", ",").alias("protected"), F.size("packs_damaged").cast("long").alias("damaged"), F.array_join("errors", ",").alias("errors")),
        f"SELECT CAST({T0} AS BIGINT) AS started, CAST({T0 + 60} AS BIGINT) AS finished, 'p1' AS protected, 0::BIGINT AS damaged, 'e' AS errors",
    ),
    "k04_index_file": (
        lambda s, d: (lambda where: (trees.write_lines(browse.index_lines(*(frame(s, d, t) for t in ("nodes", "content_blobs", "blobs", "packs")), frame(s, d, "pack_entries").groupBy("project", "sha256").agg(F.min_by("path", "id").alias("stored_path"))).select("line"), where), s.read.text(where))[1])(shared.work_dir(s, "index") + "/tsv").select(F.substring_index("value", "\t", 3).alias("line")),
        duck("SELECT concat_ws(chr(9), substring(path, 2), size, sha256) AS line FROM nodes WHERE kind = 'f' AND path IS NOT NULL"),
    ),
    "j22_stream_states": (
        lambda s, d: _stream(s, d, streams.changed_states, "event_id, state"),
        duck("SELECT event_id, state FROM (SELECT event_id, state, lag(state, 1, '') OVER (PARTITION BY job_id ORDER BY secs, event_id) AS b FROM job_events) WHERE b <> state"),
    ),
    "w07_stream_rate": (lambda s, d: _stream(s, d, lambda e: streams.speeds(e, 10_000.0), "event_id, rate"), _speed_duck(10_000)),
    "f17_stream_silent": (
        lambda s, d: _stream(s, d, lambda e: streams.silent_jobs(e, "0 seconds"), "job_id, unix_seconds(last) AS last, n"),
        duck("""SELECT job_id, max(secs) AS last, count(*) AS n FROM (SELECT job_id, secs, sum(new) OVER (PARTITION BY job_id ORDER BY secs, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT job_id, event_id, secs,
            CASE WHEN secs - lag(secs) OVER (PARTITION BY job_id ORDER BY secs, event_id) <= 15 THEN 0 ELSE 1 END AS new FROM job_events)) GROUP BY job_id, session HAVING max(secs) + 15 <= (SELECT max(secs) FROM job_events)"""),
    ),
}
