"""Copy, retrieve, import and job operators."""

_SRC = "(SELECT f.*, x.size AS d_size, x.sha256 AS d_sha, x.mtime_ns AS d_mtime FROM files f LEFT JOIN dest x ON f.path = x.path) s"
OPERATORS = {
    "j18_reconcile": lambda d: """SELECT coalesce(f.path, x.path) AS path, CASE WHEN x.path IS NULL THEN 'missing' WHEN f.path IS NULL THEN 'unexpected' WHEN f.sha256 <> x.sha256 THEN 'different' ELSE 'same' END AS verdict
        FROM files f FULL OUTER JOIN dest x ON f.path = x.path""",
    "u02_missing": lambda d: "SELECT path FROM files EXCEPT SELECT path FROM dest",
    "u03_unexpected": lambda d: "SELECT x.path FROM dest x WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.path = x.path)",
    "j21_copy_diff": lambda d: f"SELECT id, CASE WHEN d_size IS NULL THEN 'new' WHEN d_size = size AND d_mtime = mtime_ns THEN 'same' ELSE 'different' END AS verdict FROM {_SRC}",
    "j28_new_dirs": lambda d: "SELECT DISTINCT f.folder FROM files f WHERE NOT EXISTS (SELECT 1 FROM dest_folders x WHERE x.folder = f.folder)",
    "q22_move_gate": lambda d: f"""SELECT s.id, g.ok AND s.d_mtime IS NOT NULL AND s.d_mtime = s.mtime_ns AND s.d_size = s.size AS deletable FROM {_SRC}
        JOIN (SELECT source, bool_and(coalesce(d_sha = sha256, true)) AS ok FROM (SELECT * FROM {_SRC}) a GROUP BY source) g ON s.source = g.source""",
    "q40_clashes": lambda d: "SELECT f.id FROM files f WHERE f.folder = '/Library/en/src1' AND EXISTS (SELECT 1 FROM dest x WHERE x.path = f.path)",
    "a28_skip_reasons": lambda d: f"""SELECT project, CAST(sum(CASE WHEN d_sha = sha256 THEN 1 ELSE 0 END) AS BIGINT) AS already_there, CAST(sum(CASE WHEN d_sha IS NOT NULL AND d_sha <> sha256 THEN 1 ELSE 0 END) AS BIGINT) AS other FROM {_SRC} GROUP BY project""",
    "a30_job_progress": lambda d: "SELECT job_id, CASE WHEN total > 0 THEN CAST(floor(done / total * 100.0 + 0.0000001) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS percent FROM jobs",
    "j22_changed_views": lambda d: "SELECT event_id, state FROM (SELECT event_id, state, lag(state) OVER (PARTITION BY job_id ORDER BY secs, event_id) AS before FROM job_events) t WHERE before IS NULL OR before <> state",
    "j29_orphans": lambda d: "SELECT j.job_id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM job_events e WHERE e.job_id = j.job_id AND e.state = 'queued')",
    "w16_retries": lambda d: "SELECT job_id, CAST(sum(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS attempts, max_by(state, event_id) AS last_state FROM job_events GROUP BY job_id",
}
