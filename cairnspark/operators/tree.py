"""Hierarchy operators: a path's prefixes stand for the walk up its tree, so no operator recurses."""

_FOLDERS = "SELECT id, project, size, created, {p} AS folder_path FROM files"
OPERATORS = {
    "j06_subtree": lambda d: f"SELECT t.folder_path, t.id FROM ({_FOLDERS.format(p=d.prefixes('parts', drop=1))}) t WHERE t.folder_path LIKE 'Library/es%'",
    "j26_resolve": lambda d: f"SELECT f.id, f.path FROM files f JOIN (SELECT path FROM dest WHERE size > 1000) w ON f.path = w.path",
    "j27_cycle_check": lambda d: """SELECT a.folder AS moved, b.folder AS target, b.folder = a.folder OR starts_with(b.folder, a.folder || '/') AS cycle
        FROM (SELECT DISTINCT '/Library/' || project AS folder, project FROM files) a JOIN (SELECT DISTINCT folder, project FROM files) b ON a.project = b.project"""
    if d.name == "duck"
    else """SELECT a.folder AS moved, b.folder AS target, b.folder = a.folder OR startswith(b.folder, a.folder || '/') AS cycle
        FROM (SELECT DISTINCT '/Library/' || project AS folder, project FROM files) a JOIN (SELECT DISTINCT folder, project FROM files) b ON a.project = b.project""",
    "a03_folder_totals": lambda d: f"SELECT folder_path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM ({_FOLDERS.format(p=d.prefixes('parts', drop=1))}) t GROUP BY folder_path",
    "a04_delta_totals": lambda d: f"""SELECT folder_path, CAST(sum(CASE WHEN id % 17 = 0 THEN -size ELSE size END) AS BIGINT) AS delta_bytes, CAST(sum(CASE WHEN id % 17 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS delta_files
        FROM ({_FOLDERS.format(p=d.prefixes('parts', drop=1))}) t GROUP BY folder_path""",
    "x01_folder_first": lambda d: """SELECT kind, name, CAST(row_number() OVER (ORDER BY CASE WHEN kind = 'd' THEN 0 ELSE 1 END, lower(name), name) AS BIGINT) AS place FROM (
        SELECT DISTINCT 'd' AS kind, source AS name FROM files WHERE project = 'en' UNION ALL SELECT 'f' AS kind, name FROM files WHERE folder = '/Library/en/src1') t""",
    "x12_ui_sort": lambda d: "SELECT id, CAST(row_number() OVER (ORDER BY coalesce(size, -1) DESC, lower(name), id) AS BIGINT) AS place FROM files WHERE folder = '/Library/en/src1'",
}
