"""Catalog-shaped relations projected from the driver's tables, as named subqueries of one statement.

files (one per document), contents (distinct per project), blobs, packs, pack_entries, dest (a perturbed copy, for
resume and copy plans), trashed, checks, job_events. A statement pays only for the relations that it names.
"""

from __future__ import annotations

T0 = 1704067200


def relations(d) -> dict[str, str]:
    ext = "CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.fastq.gz' ELSE '.pdf' END"
    num = f"CAST(doc_id AS {d.text})"
    return {
        "raw": f"""SELECT doc_id, doc_id + 1000 AS id, lang AS project, source, '/Library/' || lang || '/' || source AS folder,
            'run' || {num} || '_' || source || 'Sample' || {ext} AS name, {d.bytes('text')} AS size, {d.sha('text')} AS sha256,
            CAST(({T0} + doc_id * 3600) * 1000000000 AS BIGINT) AS mtime_ns, {T0} + doc_id * 60 AS created FROM {d.table('documents')}""",
        "files": f"""SELECT doc_id, id, project, source, folder, name, folder || '/' || name AS path, {d.split("substring(folder || '/' || name, 2)")} AS parts,
            size, sha256, mtime_ns, CAST(CASE WHEN doc_id % 3 = 0 THEN 420 ELSE 493 END AS INT) AS mode, created FROM raw""",
        "contents": "SELECT project, sha256, min(id) AS carrier_id, max(size) AS size, count(*) AS refs FROM files GROUP BY project, sha256",
        "small": f"""SELECT c.*, {d.div('carrier_id', '64')} AS batch FROM contents c WHERE size <= 2000""",
        "content_blobs": """SELECT project, sha256, carrier_id, size, carrier_id AS blob_id, 'f' AS kind, CAST(0 AS BIGINT) AS blob_off FROM contents WHERE size > 2000
            UNION ALL SELECT project, sha256, carrier_id, size, min(carrier_id) OVER (PARTITION BY project, batch) AS blob_id, 's' AS kind,
            CAST(coalesce(sum(size) OVER (PARTITION BY project, batch ORDER BY carrier_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blob_off FROM small""",
        "sized_blobs": f"SELECT blob_id, project, kind, CAST(sum(size) AS BIGINT) AS raw_len, {d.div('CAST(sum(size) AS BIGINT)', '3')} + 40 AS data_len FROM content_blobs GROUP BY blob_id, project, kind",
        "placed_blobs": f"""SELECT b.*, CAST(coalesce(sum(data_len) OVER (PARTITION BY project, {d.div('blob_id', '256')} ORDER BY blob_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS secs, {d.div('blob_id', '256')} AS pack_ord FROM sized_blobs b""",
        "blobs": f"""SELECT blob_id, project, kind, raw_len, data_len, pack_ord, secs AS data_off, min(blob_id) OVER (PARTITION BY project, pack_ord) AS pack_id FROM placed_blobs""",
        "packs": f"""SELECT pack_id, project, pack_ord, CAST(sum(data_len) AS BIGINT) AS bytes,
            CASE pack_ord % 4 WHEN 0 THEN 'sealed' WHEN 1 THEN 'protected' WHEN 2 THEN 'open' ELSE 'damaged' END AS state,
            CASE WHEN pack_id % 3 = 0 THEN NULL ELSE {T0} + pack_id * 7200 END AS checked_at FROM blobs GROUP BY pack_id, project, pack_ord""",
        "pack_entries": """SELECT f.id, b.pack_id, f.path, f.name, f.folder, f.project, f.sha256, f.size, f.mtime_ns, cb.blob_id, cb.blob_off, b.kind AS blob_kind, b.data_len, b.raw_len,
            cb.carrier_id, f.id = cb.carrier_id AS is_carrier FROM files f JOIN content_blobs cb ON f.project = cb.project AND f.sha256 = cb.sha256 JOIN blobs b ON cb.blob_id = b.blob_id AND cb.project = b.project""",
        "folder_names": f"""SELECT DISTINCT {d.prefixes('parts', drop=1)} AS rel FROM files""",
        "folder_rows": f"""SELECT CAST(row_number() OVER (ORDER BY rel) + 2 AS BIGINT) AS id, '/' || rel AS path, {d.at(d.split('rel'), '-1')} AS name, {d.size(d.split('rel'))} AS depth,
            {d.join(d.first_n(d.split('rel'), d.size(d.split('rel')) + ' - 1'))} AS up, CASE WHEN {d.size(d.split('rel'))} > 1 THEN {d.at(d.split('rel'), '2')} END AS project FROM folder_names""",
        "live_files": "SELECT * FROM files WHERE doc_id % 17 <> 0",
        "folder_sums": f"""SELECT rel, CAST(sum(size) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n_files FROM (SELECT {d.prefixes('parts', drop=1)} AS rel, size FROM live_files) t GROUP BY rel""",
        "projects": "SELECT project, id AS root FROM folder_rows WHERE depth = 2",
        "nodes": f"""SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, '/' AS path, '' AS name, 'd' AS kind, CAST(NULL AS {d.text}) AS project, CAST(NULL AS {d.text}) AS sha256, CAST(0 AS BIGINT) AS size,
                CAST(0 AS BIGINT) AS mtime_ns, CAST(0 AS BIGINT) AS created, CAST(NULL AS BIGINT) AS trashed_at, CAST(NULL AS {d.text}) AS trash_origin
            UNION ALL SELECT CAST(2 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS {d.text}), '.trash', 'd', CAST(NULL AS {d.text}), CAST(NULL AS {d.text}), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS {d.text})
            UNION ALL SELECT f.id, coalesce(u.id, CAST(1 AS BIGINT)), f.path, f.name, 'd', f.project, CAST(NULL AS {d.text}), coalesce(s.size, CAST(0 AS BIGINT)), CAST({T0} AS BIGINT) * 1000000000, CAST({T0} AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS {d.text})
                FROM folder_rows f LEFT JOIN folder_rows u ON u.path = '/' || f.up LEFT JOIN folder_sums s ON f.path = '/' || s.rel
            UNION ALL SELECT f.id, CASE WHEN f.doc_id % 17 = 0 THEN CAST(2 AS BIGINT) ELSE p.id END, CASE WHEN f.doc_id % 17 <> 0 THEN f.path END, CASE WHEN f.doc_id % 17 = 0 THEN CAST(f.id AS {d.text}) ELSE f.name END, 'f', f.project, f.sha256, f.size,
                f.mtime_ns, f.created, CASE WHEN f.doc_id % 17 = 0 THEN {T0} + f.doc_id * 3600 END, CASE WHEN f.doc_id % 17 = 0 THEN f.path END
                FROM files f JOIN folder_rows p ON p.path = f.folder""",
        "dest": """SELECT path, size, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE sha256 END AS sha256, CASE WHEN doc_id % 11 = 0 THEN mtime_ns + 1000 ELSE mtime_ns END AS mtime_ns
            FROM files WHERE doc_id % 5 <> 0""",
        "expected": "SELECT path FROM files WHERE doc_id % 3 <> 0",
        "dest_folders": "SELECT DISTINCT folder FROM files WHERE doc_id % 2 = 0",
        "trashed": f"SELECT id, path, project, size, sha256, {T0} + doc_id * 3600 AS trashed_at FROM files WHERE doc_id % 17 = 0",
        "checks": f"SELECT l.doc_id + 1000 AS id, l.toxic = 0 AS passed, l.quality = 1 AS repairable FROM {d.table('labels')} l",
        "job_events": f"""SELECT user_id AS job_id, event_id, {d.epoch('ts')} AS secs, value AS bytes,
            CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state FROM {d.table('events')}""",
        "jobs": """SELECT job_id, max(secs) AS updated, min(secs) AS started, max_by(state, (secs, event_id)) AS state, sum(bytes) AS total,
            sum(CASE WHEN state = 'done' THEN bytes ELSE 0.0 END) AS done, count(*) AS n_events FROM job_events GROUP BY job_id"""
        if d.name == "duck"
        else """SELECT job_id, max(secs) AS updated, min(secs) AS started, max_by(state, struct(secs, event_id)) AS state, sum(bytes) AS total,
            sum(CASE WHEN state = 'done' THEN bytes ELSE CAST(0.0 AS DOUBLE) END) AS done, count(*) AS n_events FROM job_events GROUP BY job_id""",
    }


def frame(spark, sf_dir: str, relation: str):
    """One relation as a DataFrame."""
    from cairnspark.plans.dialect import Spark

    return spark.sql(statement(Spark(sf_dir), f"SELECT * FROM {relation}"))


def duck(select: str) -> str:
    """A hand-written statement for the other engine over the relations that it names."""
    from cairnspark.plans.dialect import Duck

    return statement(Duck(), select)


def statement(d, select: str) -> str:
    import re

    made, need, out = relations(d), [select], {}
    while need:  # only what is named, in the order of definition
        for name in made:
            if name not in out and any(re.search(rf"\b{name}\b", s) for s in need):
                out[name] = made[name]
                need.append(made[name])
                break
        else:
            break
    order = [n for n in made if n in out]
    return (f"WITH {', '.join(f'{n} AS ({out[n]})' for n in order)} " if order else "") + select
