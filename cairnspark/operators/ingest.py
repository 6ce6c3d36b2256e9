"""Dedup, resume, conflict and packing plans."""

_SRC = "(SELECT f.*, x.size AS d_size, x.sha256 AS d_sha, x.mtime_ns AS d_mtime FROM files f LEFT JOIN dest x ON f.path = x.path) s"


OPERATORS = {
    "f11_size_present": lambda d: "SELECT f.id FROM files f WHERE EXISTS (SELECT 1 FROM dest x WHERE x.size = f.size)",
    "f12_have": lambda d: "SELECT f.id FROM files f WHERE EXISTS (SELECT 1 FROM dest x WHERE x.sha256 = f.sha256)",
    "f20_same_file": lambda d: f"SELECT id, coalesce(size = d_size AND mtime_ns = d_mtime, false) AS same FROM {_SRC}",
    "a11_scan_totals": lambda d: "SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT folder) AS n_folders FROM files",
    "a12_size_histogram": lambda d: "SELECT project, size, count(*) AS n FROM files GROUP BY project, size",
    "a13_distinct_digests": lambda d: "SELECT DISTINCT project, sha256 FROM files",
    "a14_first_seen": lambda d: "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project, sha256 ORDER BY id) AS rn FROM files) t WHERE rn = 1",
    "a15_scope_order": lambda d: "SELECT project, min(id) AS first_id, CAST(row_number() OVER (ORDER BY min(id)) AS BIGINT) AS place FROM files GROUP BY project",
    "a16_islands": lambda d: """SELECT grp, min(event_id) AS first_event, count(*) AS n, max(state) AS state FROM (
        SELECT event_id, state, job_id, CAST(sum(CASE WHEN state = before THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY secs, event_id) AS BIGINT) AS grp FROM (
            SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY secs, event_id) AS before FROM job_events) a) b GROUP BY job_id, grp""",
    "a18_outcomes": lambda d: f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN d_sha IS NULL THEN 'stored' WHEN d_sha = sha256 THEN 'identical' ELSE 'failed' END AS outcome FROM {_SRC}) t GROUP BY outcome""",
    "w01_carrier": lambda d: "SELECT id, row_number() OVER (PARTITION BY project, sha256 ORDER BY id) = 1 AS carries FROM files",
    "w02_heir": lambda d: "SELECT id, coalesce(lead(id) OVER (PARTITION BY project, sha256 ORDER BY id), -1) AS heir FROM files",
    "w03_first_path": lambda d: "SELECT id, first_value(path) OVER (PARTITION BY project, sha256 ORDER BY id) AS first_path FROM files",
    "j15_existing": lambda d: f"SELECT id, CASE WHEN d_size IS NULL THEN 'pending' WHEN d_size = size THEN 'to_check' ELSE 'pending' END AS route FROM {_SRC}",
    "q08_dedup_plan": lambda d: """SELECT id, CASE WHEN have THEN 'link' WHEN repeats = 1 AND NOT size_there THEN 'send' WHEN rn = 1 THEN 'first_copy' ELSE 'deferred_link' END AS plan FROM (
        SELECT f.id, h.sha256 IS NOT NULL AS have, z.size IS NOT NULL AS size_there, count(*) OVER (PARTITION BY f.project, f.size) AS repeats,
            row_number() OVER (PARTITION BY f.project, f.sha256 ORDER BY f.id) AS rn FROM files f
        LEFT JOIN (SELECT DISTINCT sha256 FROM dest) h ON f.sha256 = h.sha256 LEFT JOIN (SELECT DISTINCT size FROM dest) z ON f.size = z.size) t""",
    "q09_resume": lambda d: f"SELECT id, CASE WHEN d_size IS NULL OR d_size <> size THEN 'pending' WHEN d_sha = sha256 THEN 'identical' ELSE 'resend' END AS class FROM {_SRC}",
    "w11_cascade": lambda d: """SELECT id, CASE WHEN bad_before > 0 THEN 'discarded' WHEN bad = 1 THEN 'failed' ELSE 'committed' END AS outcome FROM (
        SELECT e.id, CASE WHEN k.passed THEN 0 ELSE 1 END AS bad, coalesce(sum(CASE WHEN k.passed THEN 0 ELSE 1 END) OVER (PARTITION BY e.pack_id, e.project ORDER BY e.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad_before
        FROM pack_entries e JOIN checks k ON e.id = k.id) t""",
    "q13_duplicates_tsv": lambda d: """SELECT e.path || chr(9) || s.path || chr(9) || e.sha256 AS line FROM pack_entries e JOIN pack_entries s ON e.carrier_id = s.id AND e.project = s.project
        WHERE NOT e.is_carrier AND NOT contains(e.path, chr(9))""",
}
