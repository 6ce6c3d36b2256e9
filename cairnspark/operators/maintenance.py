"""Scrub, protection, purge, rebuild and snapshot operators."""

T0 = 1704067200
_OUT = "(SELECT p.*, k.passed, k.repairable FROM packs p LEFT JOIN checks k ON p.pack_id = k.id) t"
OPERATORS = {
    "f13_packs_in_state": lambda d: "SELECT pack_id, project FROM packs WHERE state = 'sealed'",
    "f14_trash_due": lambda d: f"SELECT id FROM trashed WHERE trashed_at < {T0 + 1_000_000}",
    "f15_scrub_due": lambda d: f"SELECT pack_id, project FROM packs WHERE checked_at IS NULL OR checked_at < {T0 + 9_000_000}",
    "x06_scrub_order": lambda d: "SELECT pack_id, project, CAST(row_number() OVER (ORDER BY coalesce(checked_at, 0), pack_id, project) AS BIGINT) AS place FROM packs",
    "w04_latest_open": lambda d: "SELECT project, max(pack_id) AS pack_id FROM packs WHERE state = 'open' GROUP BY project",
    "w05_snapshots": lambda d: f"SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS rn FROM (SELECT DISTINCT {d.strftime('created', '%Y-%m-%d')} AS day FROM files) a) b WHERE rn <= 3",
    "x14_last_write": lambda d: """SELECT path, sha256 FROM (SELECT path, sha256, row_number() OVER (PARTITION BY path ORDER BY src DESC, id DESC) AS rn FROM (
        SELECT path, sha256, 1 AS src, id FROM files UNION ALL SELECT x.path, x.sha256, 2 AS src, CAST(0 AS BIGINT) AS id FROM dest x) a) b WHERE rn = 1""",
}
