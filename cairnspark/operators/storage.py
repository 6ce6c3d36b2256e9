"""Content, blob and pack operators: location joins, index lines, summaries, savings."""

from cairnspark.functions import names as n

OPERATORS = {
    "j01_entry": lambda d: "SELECT f.id, f.path, c.carrier_id, c.refs FROM files f LEFT JOIN contents c ON f.project = c.project AND f.sha256 = c.sha256",
    "j03_location": lambda d: "SELECT c.project, c.sha256, p.pack_id, p.state, b.data_off + c.blob_off AS secs, c.size FROM content_blobs c JOIN blobs b ON c.blob_id = b.blob_id AND c.project = b.project JOIN packs p ON b.pack_id = p.pack_id AND b.project = p.project",
    "j04_pack_members": lambda d: f"SELECT e.id, e.pack_id, CASE WHEN e.blob_kind = 's' THEN '.solid/' || CAST(e.blob_id AS {d.text}) || '.tar.zst' ELSE e.name || '.zst' END AS member FROM pack_entries e",
    "j05_stored_path": lambda d: "SELECT project, sha256, min_by(path, id) AS stored_path FROM pack_entries GROUP BY project, sha256",
    "j08_deep_check": lambda d: "SELECT blob_id, pack_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(blob_off + size) AS reach, max(raw_len) AS raw_len FROM pack_entries WHERE is_carrier GROUP BY blob_id, pack_id",
    "j09_index_tsv": lambda d: f"""SELECT e.path || chr(9) || CAST(e.size AS {d.text}) || chr(9) || e.sha256 || chr(9) || 'pack-' || {d.lpad('e.pack_id', 8)} || chr(9) || CAST(e.blob_off AS {d.text}) || chr(9) || CASE WHEN e.is_carrier THEN '' ELSE s.path END AS line
        FROM pack_entries e JOIN pack_entries s ON e.carrier_id = s.id AND e.project = s.project""",
    "j20_frame_plan": lambda d: f"""SELECT c.project, c.sha256, min(f.frame) AS first_frame, max(f.frame) AS last_frame, count(*) AS n_frames FROM content_blobs c
        JOIN (SELECT blob_id, project, i - 1 AS frame FROM (SELECT blob_id, project, {d.numbers(d.div('raw_len + 999', '1000'))} AS i FROM sized_blobs WHERE raw_len > 0) z) f
        ON c.blob_id = f.blob_id AND c.project = f.project AND f.frame * 1000 < c.blob_off + c.size AND f.frame * 1000 + 1000 > c.blob_off WHERE c.size > 0 GROUP BY c.project, c.sha256""",
    "w06_frame_offsets": lambda d: "SELECT blob_id, project, data_len, secs AS offset_before FROM placed_blobs",
    "q16_deep_check": lambda d: f"SELECT e.pack_id, count(*) AS n, sum(CASE WHEN {d.sha('t.text')} <> e.sha256 THEN 1 ELSE 0 END) = 0 AS sound FROM pack_entries e JOIN {d.table('documents')} t ON e.id = t.doc_id + 1000 GROUP BY e.pack_id",
    "a01_solid_count": lambda d: "SELECT pack_id, project, CAST(sum(CASE WHEN kind = 's' THEN 1 ELSE 0 END) AS BIGINT) AS n_solid FROM blobs GROUP BY pack_id, project",
    "a02_carrier": lambda d: "SELECT id, min(id) OVER (PARTITION BY project, sha256) AS carrier_id FROM files",
    "a19_refs": lambda d: "SELECT project, sha256, count(*) AS refs FROM files GROUP BY project, sha256",
    "a06_distinct_bytes": lambda d: "SELECT project, CAST(sum(size) AS BIGINT) AS distinct_bytes FROM contents GROUP BY project",
    "a07_protection": lambda d: """SELECT project, CASE WHEN count(*) = 0 THEN 'none' WHEN bool_or(state = 'damaged') THEN 'damaged' WHEN bool_and(state = 'protected') THEN 'protected' ELSE 'pending' END AS protection FROM packs GROUP BY project""",
    "a08_last_checked": lambda d: "SELECT project, CASE WHEN count(*) = count(checked_at) THEN min(checked_at) ELSE -1 END AS last_checked FROM packs GROUP BY project",
    "a09_pack_status": lambda d: f"""SELECT project, count(*) AS total, CAST(sum(CASE WHEN state = 'sealed' THEN 1 ELSE 0 END) AS BIGINT) AS sealed, CAST(sum(CASE WHEN state = 'protected' THEN 1 ELSE 0 END) AS BIGINT) AS protected,
        coalesce({d.join(d.sorted_list(f"CASE WHEN state = 'damaged' THEN {d.lpad('pack_id', 8)} END") if d.name == 'spark' else "list_sort(list(lpad(CAST(pack_id AS VARCHAR), 8, '0')) FILTER (WHERE state = 'damaged'))", ',')}, '') AS damaged FROM packs GROUP BY project""",
    "a10_measure": lambda d: "SELECT project, count(*) AS n_files, count(DISTINCT folder) AS n_folders, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE name NOT LIKE '.%' GROUP BY project",
    "a23_selection": lambda d: "SELECT folder, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM files GROUP BY folder",
    "a24_savings": lambda d: f"""SELECT project, {d.div('(original - stored) * 100', 'original')} AS saved_floor, round(100.0 - CAST(stored AS DOUBLE) * 100.0 / CAST(original AS DOUBLE), 0) AS saved_round FROM (
        SELECT e.project, CAST(sum(e.size) AS BIGINT) AS original, CAST(sum(CASE WHEN e.is_carrier THEN {n.share(d, 'e')} ELSE 0 END) AS BIGINT) AS stored FROM pack_entries e GROUP BY e.project) t WHERE original > 0""",
    "a27_manifest": lambda d: f"SELECT pack_id, project, {d.join(d.sorted_list('path'), '|')} AS entries FROM pack_entries GROUP BY pack_id, project",
}
