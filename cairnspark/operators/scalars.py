"""Scalar operators applied to whole tables."""

from cairnspark.functions import names as n

NS = 1_000_000_000
OPERATORS = {
    "c01_name_pieces": lambda d: f"SELECT id, {n.pieces(d, 'name')} AS pieces FROM files",
    "c08_dates": lambda d: f"SELECT id, {d.strftime(d.div('mtime_ns', str(NS)), '%Y-%m')} AS year_month, {d.strftime(d.div('mtime_ns', str(NS)), '%Y-%m-%d')} AS day FROM files",
    "c09_touch": lambda d: f"SELECT id, {d.strftime(d.div('mtime_ns', str(NS)), '%Y%m%d%H%M.%S')} AS stamp FROM files",
    "c12_numbered": lambda d: f"SELECT id, {n.numbered(d, 'name', '2')} AS second FROM files",
    "c14_tsv_escape": lambda d: f"SELECT doc_id, {n.tsv('text')} AS escaped FROM {d.table('documents')}",
    "c15_path_parts": lambda d: f"SELECT id, {d.size('parts')} AS depth, {d.at('parts', 1)} AS top, {d.join(d.first_n('parts', '3'))} AS parent FROM files",
    "c17_crumbs": lambda d: f"SELECT id, {d.prefixes('parts')} AS crumb FROM files",
    "c19_part_name": lambda d: "SELECT id, folder || '/.' || name || '.part' AS part_path FROM files",
    "c20_sha": lambda d: "SELECT id, sha256 FROM files",
    "c21_stored_share": lambda d: f"SELECT e.id, {n.share(d, 'e')} AS stored FROM pack_entries e",
    "c22_pack_name": lambda d: f"SELECT pack_id, {d.strftime('1704067200 + pack_id * 7200', '%Y-%m')} || '/pack-' || {d.lpad('pack_id', 8)} || '.tar' AS pack_name FROM packs",
    "c31_floor_ns": lambda d: f"""SELECT id, {d.div(f'v - ((v % {NS} + {NS}) % {NS})', str(NS))} AS seconds, (v % {NS} + {NS}) % {NS} AS nanos
        FROM (SELECT id, mtime_ns - 1704500000123456789 AS v FROM files) t""",
    "c27_safe_path": lambda d: f"SELECT page_id, NOT ({d.rlike('url', '^/')} OR {d.rlike('url', '(^|/)[.][.](/|$)')} OR url = '') AS safe FROM {d.table('pages')}",
    "c35_hit_folder": lambda d: "SELECT id, substring(folder, length('/Library/') + 1) AS shown FROM files WHERE folder LIKE '/Library/%'",
    "f10_hidden": lambda d: f"SELECT page_id, {d.rlike('url', '(^|/)[.][^/]')} AS hidden FROM {d.table('pages')}",
    "f26_clean_names": lambda d: f"SELECT doc_id, NOT (contains(text, chr(9)) OR contains(text, chr(10)) OR contains(text, chr(13))) AS clean FROM {d.table('documents')}",

}
