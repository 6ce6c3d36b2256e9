"""Browsing and searching as registered queries, and what they give written anew for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.api import browse, changes, search
from cairnspark.sources import trees
from cairnspark.sources.fixtures import duck, frame


def _expanded(x: str) -> str:
    borders = (r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})", r"(\p{Lu})(\p{Lu}\p{Ll})")
    run = "r"
    for b in borders:
        run = rf"regexp_replace({run}, '{b}', '\1 \2', 'g')"
    return rf"array_to_string([{x}] || flatten(list_filter(list_transform(list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}]+'), lambda r: r <> ''), lambda r: string_split({run}, ' ')), lambda p: len(p) > 1)), ' ')"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


_INDEX = f"""live AS (SELECT id, path, name, kind, size, mtime_ns FROM nodes WHERE path IS NOT NULL AND path <> '/'),
    above AS (SELECT l.id, string_agg({_expanded('a.name')}, ' ' ORDER BY length(a.path)) AS said FROM live l JOIN live a ON a.kind = 'd' AND starts_with(l.path, a.path || '/') GROUP BY l.id),
    idx AS (SELECT l.*, {_tokens(_expanded('l.name'))} AS words, {_tokens("coalesce(a.said, '')")} AS folders FROM live l LEFT JOIN above a ON l.id = a.id)"""


def _in(select: str) -> str:
    """A statement that begins with its own named parts, after those of the fixtures."""
    whole = duck(f"SELECT * FROM nodes /*{select}*/")
    head = whole[: whole.rindex("SELECT * FROM nodes /*")]
    return head.rstrip() + ", " + select


def _ranked(terms: list[tuple[str, str]], where: str = "true", best: int = 1000) -> str:
    """The best rows with a score for terms given as (test on a list of words w, name)."""
    parts, scores = [], []
    for k, (count, _) in enumerate(terms):
        parts.append(f"CAST({count.format(w='words')} AS DOUBLE) AS w{k}, CAST({count.format(w='folders')} AS DOUBLE) AS f{k}")
        scores.append(f"greatest(ln(((SELECT count(*) FROM t) - (SELECT count(*) FROM t WHERE w{k} + f{k} > 0) + 0.5) / ((SELECT count(*) FROM t WHERE w{k} + f{k} > 0) + 0.5)), 1e-6) * (10 * w{k} + f{k}) * 2.2 / (10 * w{k} + f{k} + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM t)))")
    return _in(f"""{_INDEX}, t AS (SELECT *, len(words) + len(folders) AS n, {', '.join(parts)} FROM idx)
        SELECT id, round(raw, 6) AS score FROM (SELECT *, -({' + '.join(scores)}) AS raw FROM t WHERE {' AND '.join(f'w{k} + f{k} > 0' for k in range(len(terms)))} AND {where})
        ORDER BY round(raw, 9), kind <> 'd', translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), path LIMIT {best}""")  # fmt: skip


def _starts(token: str) -> tuple[str, str]:
    return f"len(list_filter({{w}}, lambda x: starts_with(x, '{token}')))", token


def _find(query: str, limit: int = 1000):
    def run(s, d):
        n = frame(s, d, "nodes")
        return search.search(n, search.word_index(n), query, limit).select("id", F.round("score", 6).alias("score"))

    return run


def _info(path: str):
    def run(s, d):
        x = browse.info(*(frame(s, d, t) for t in ("nodes", "content_blobs", "blobs", "packs")), path)
        return x.select("path", "kind", "files", "folders", "original_bytes", "stored_bytes", "duplicate_bytes", "archived_at", "protection", "last_checked")

    return run


def _info_duck(path: str) -> str:
    below = "true" if path == "/" else f"(path = '{path}' OR path LIKE '{path}/%')"
    return duck(f"""SELECT '{path}' AS path, (SELECT kind FROM nodes WHERE path = '{path}') AS kind, count(*) FILTER (WHERE kind = 'f') AS files, count(*) FILTER (WHERE kind = 'd' AND path <> '{path}') AS folders,
        CAST(coalesce(sum(size) FILTER (WHERE kind = 'f'), 0) AS BIGINT) AS original_bytes, CAST((SELECT round(sum(CASE WHEN b.kind = 's' AND b.raw_len > 0 THEN b.data_len::DOUBLE * u.size / b.raw_len ELSE b.data_len END))
            FROM (SELECT DISTINCT project, sha256 FROM nodes WHERE path IS NOT NULL AND kind = 'f' AND {below}) k JOIN content_blobs u USING (project, sha256) JOIN blobs b ON u.blob_id = b.blob_id AND u.project = b.project) AS BIGINT) AS stored_bytes,
        CAST(coalesce(sum(size) FILTER (WHERE kind = 'f'), 0) - (SELECT coalesce(sum(size), 0) FROM (SELECT DISTINCT project, sha256, size FROM nodes WHERE path IS NOT NULL AND kind = 'f' AND {below})) AS BIGINT) AS duplicate_bytes, max(created) AS archived_at,
        (SELECT CASE WHEN count(*) = 0 THEN 'none' WHEN bool_or(p.state = 'damaged') THEN 'damaged' WHEN bool_and(p.state = 'protected') THEN 'protected' ELSE 'pending' END
            FROM (SELECT DISTINCT project, sha256 FROM nodes WHERE path IS NOT NULL AND kind = 'f' AND {below}) k JOIN content_blobs u USING (project, sha256) JOIN blobs b ON u.blob_id = b.blob_id AND u.project = b.project JOIN packs p ON p.pack_id = b.pack_id AND p.project = b.project) AS protection,
        (SELECT CASE WHEN bool_and(p.checked_at IS NOT NULL) THEN min(p.checked_at) END
            FROM (SELECT DISTINCT project, sha256 FROM nodes WHERE path IS NOT NULL AND kind = 'f' AND {below}) k JOIN content_blobs u USING (project, sha256) JOIN blobs b ON u.blob_id = b.blob_id AND u.project = b.project JOIN packs p ON p.pack_id = b.pack_id AND p.project = b.project) AS last_checked
        FROM nodes WHERE path IS NOT NULL AND {below}""")  # fmt: skip


QUERIES = {
    "f01_entries": (
        lambda s, d: browse.entries(frame(s, d, "nodes").withColumn("stored", F.col("size") - 500), frame(s, d, "projects")).select("id", "is_project", "in_project", "stored"),
        duck("SELECT n.id, EXISTS (SELECT 1 FROM projects p WHERE p.root = n.id) AS is_project, n.project IS NOT NULL AS in_project, CASE WHEN n.size < 500 THEN 0 ELSE n.size - 500 END AS stored FROM nodes n"),
    ),
    "f02_by_id": (lambda s, d: browse.by_id(frame(s, d, "nodes"), 1005).select("id", "name", "kind"), duck("SELECT id, name, kind FROM nodes WHERE id = 1005")),
    "f03_child": (
        lambda s, d: browse.child(frame(s, d, "nodes"), 3, "en").union(browse.child(frame(s, d, "nodes"), 3, "EN")).select("id", "name"),
        duck("SELECT id, name FROM nodes WHERE path = '/Library/en'"),
    ),
    "f04_children": (lambda s, d: browse.children(frame(s, d, "nodes"), 3).select("id", "name"), duck("SELECT id, name FROM nodes WHERE path IS NOT NULL AND len(string_split(path, '/')) = 3")),
    "j25_path_of": (
        lambda s, d: browse.paths_of(frame(s, d, "nodes")),
        duck("SELECT id, CASE WHEN trashed_at IS NOT NULL THEN '/' || id ELSE path END AS path, trashed_at IS NOT NULL AS in_trash, false AS detached FROM nodes WHERE id > 2"),
    ),
    "j25_ancestors": (
        lambda s, d: browse.ancestors(frame(s, d, "nodes")).select("id", "ancestor", F.col("distance").cast("long").alias("distance")),
        duck("""SELECT n.id, a.id AS ancestor, CAST(len(string_split(n.path, '/')) - CASE a.path WHEN '/' THEN 1 ELSE len(string_split(a.path, '/')) END AS BIGINT) AS distance FROM nodes n JOIN nodes a
            ON n.path <> '/' AND n.path <> a.path AND (a.path = '/' OR starts_with(n.path, a.path || '/')) UNION ALL SELECT id, 2, 1 FROM nodes WHERE trashed_at IS NOT NULL"""),
    ),
    "q01_list": (
        lambda s, d: browse.list_folder(frame(s, d, "nodes"), "/Library//en/").select("id", "kind", "name", "size"),
        duck("SELECT id, kind, name, size FROM nodes WHERE path LIKE '/Library/en/%' AND length(path) - length(replace(path, '/', '')) = 3"),
    ),
    "q02_stat": (
        lambda s, d: browse.stat(frame(s, d, "nodes"), frame(s, d, "projects"), "/Library/de/src1").select("id", "path", "project", "project_path", "is_project", "in_project"),
        duck("SELECT id, path, 'de' AS project, '/Library/de' AS project_path, false AS is_project, true AS in_project FROM nodes WHERE path = '/Library/de/src1'"),
    ),
    "q03_walk": (lambda s, d: browse.walk(frame(s, d, "nodes"), "/Library/fr").select("id", "rel", "kind"), duck("SELECT id, replace(path, '/Library/fr/', '') AS rel, kind FROM nodes WHERE path LIKE '/Library/fr/%'")),
    "q05_info": (_info("/Library/en"), _info_duck("/Library/en")),
    "q05_info_root": (_info("/"), _info_duck("/")),
    "j17_project_of_path": (
        lambda s, d: browse.project_of(s.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", "'/Library/' || element_at(array('en', 'fr', 'xx', 'de'), CAST(page_id % 4 + 1 AS INT)) || '/src' || CAST(page_id % 13 AS STRING) || '/new/' || CAST(page_id AS STRING) AS path"), frame(s, d, "nodes").where("kind = 'd'")).select("page_id", "project", "found"),
        duck("""SELECT page_id, max_by(n.project, length(n.path)) AS project, max_by(n.path, length(n.path)) AS found FROM (SELECT page_id, '/Library/' || ['en', 'fr', 'xx', 'de'][page_id % 4 + 1] || '/src' || page_id % 13 || '/new/' || page_id AS p FROM pages) w
            JOIN nodes n ON n.kind = 'd' AND (n.path = '/' OR starts_with(w.p, n.path || '/')) GROUP BY page_id"""),
    ),
    "q07_word_index": (
        lambda s, d: (lambda x: x.select("id", F.lit("words").alias("field"), F.explode("words").alias("token")).union(x.select("id", F.lit("folders"), F.explode("folders"))).groupBy("id", "field", "token").count().withColumnRenamed("count", "tf"))(search.word_index(frame(s, d, "nodes"))),
        _in(f"{_INDEX} SELECT id, field, token, count(*) AS tf FROM (SELECT id, 'words' AS field, unnest(words) AS token FROM idx UNION ALL SELECT id, 'folders' AS field, unnest(folders) AS token FROM idx) GROUP BY ALL"),
    ),
    "q04_search_words": (_find("src1 samp"), _ranked([_starts("src1"), _starts("samp")])),
    "q04_search_phrase": (
        _find('"src 2 Sample" run'),
        _ranked([("len(list_filter(range(1, len({w})), lambda i: {w}[i] = 'src' AND {w}[i + 1] = '2' AND {w}[i + 2] = 'sample'))", ""), _starts("run")]),
    ),
    "q04_search_filters": (
        _find("run type:.GZ after:2024-01-03 size:>=0.4k is:file"),
        _ranked([_starts("run")], "kind = 'f' AND (lower(name) LIKE '%.gz' OR lower(name) LIKE '%.gz.%') AND mtime_ns >= epoch_ns(TIMESTAMP '2024-01-03') AND size >= 400"),
    ),
    "q04_search_folders": (_find("is:folder src"), _ranked([_starts("src")], "kind = 'd'")),
    "q04_search_empty": (_find(" * ( "), duck("SELECT id, 0.0 AS score FROM nodes WHERE false")),
    "x02_rank_limit": (
        _find("run", 17),
        _ranked([_starts("run")], best=17),
    ),
    "x03_filter_order": (
        _find("type:pdf >1KB", 25),
        duck("SELECT id, 0.0 AS score FROM (SELECT id, name, path FROM nodes WHERE kind = 'f' AND path IS NOT NULL AND size > 1000 AND (name ILIKE '%.pdf' OR name ILIKE '%.pdf.%') ORDER BY lower(name), path LIMIT 25)"),
    ),
    "x04_clamp": (
        lambda s, d: _find("before:3000", 5000)(s, d).agg(F.count(F.lit(1)).alias("n")),
        duck("SELECT least(count(*), 1000) AS n FROM nodes WHERE path IS NOT NULL AND path <> '/'"),
    ),
    "s11_scan": (
        lambda s, d: search.scan(frame(s, d, "files").withColumn("kind", F.lit("f")), "RUN1 *samp* >100", 40).select("id", "truncated"),
        duck("SELECT id, (SELECT count(*) FROM files WHERE name LIKE '%run1%' AND name ILIKE '%samp%' AND size > 100) > 40 AS truncated FROM files WHERE name LIKE '%run1%' AND name ILIKE '%samp%' AND size > 100 ORDER BY path LIMIT 40"),
    ),
    "j14_revalidated": (
        lambda s, d: search.revalidated(frame(s, d, "files").select("id", "path"), frame(s, d, "dest"), "/Library/de").select("id"),
        duck("SELECT f.id FROM files f WHERE f.project = 'de' AND f.path IN (SELECT path FROM dest)"),
    ),
    "k04_index_lines": (
        lambda s, d: browse.index_lines(*(frame(s, d, t) for t in ("nodes", "content_blobs", "blobs", "packs")), frame(s, d, "pack_entries").groupBy("project", "sha256").agg(F.min_by("path", "id").alias("stored_path"))),
        duck("""SELECT n.path, concat_ws(chr(9), substring(n.path, 2), n.size, n.sha256, 'pack-' || lpad(CAST(b.pack_id AS VARCHAR), 8, '0'), b.data_off, b.data_len, CASE b.kind WHEN 's' THEN CAST(c.blob_off AS VARCHAR) ELSE '' END, CASE b.kind WHEN 's' THEN 'solid' ELSE 'file' END,
            CASE WHEN e.path = n.path THEN '' ELSE substring(e.path, 2) END) AS line FROM nodes n JOIN content_blobs c ON n.project = c.project AND n.sha256 = c.sha256 JOIN blobs b ON b.blob_id = c.blob_id AND b.project = c.project
            JOIN files e ON e.id = c.carrier_id WHERE n.kind = 'f' AND n.path IS NOT NULL"""),
    ),
    "w17_between": (
        lambda s, d: changes.between(frame(s, d, "files").where("project = 'en'"), [F.lower("name"), F.col("id")], F.col("name").startswith("run10"), F.col("name").startswith("run5")).select("id"),
        duck("""SELECT id FROM files WHERE project = 'en' AND (lower(name), id) >= (SELECT min((lower(name), id)) FROM files WHERE project = 'en' AND (name LIKE 'run10%' OR name LIKE 'run5%'))
            AND (lower(name), id) <= (SELECT max((lower(name), id)) FROM files WHERE project = 'en' AND (name LIKE 'run10%' OR name LIKE 'run5%'))
            AND EXISTS (SELECT 1 FROM files WHERE project = 'en' AND name LIKE 'run10%') AND EXISTS (SELECT 1 FROM files WHERE project = 'en' AND name LIKE 'run5%')"""),
    ),
    "k12_as_text": (
        lambda s, d: trees.as_text(frame(s, d, "nodes").where("path IS NOT NULL")),
        duck("""SELECT path, kind || '  ' || lpad(CASE WHEN kind = 'd' THEN '-' WHEN size < 1000 THEN size || ' B' WHEN size < 10000 THEN printf('%.1f KB', size / 1000.0::DOUBLE) WHEN size < 1000000 THEN printf('%.0f KB', size / 1000.0::DOUBLE) ELSE printf('%.1f MB', size / 1000000.0::DOUBLE) END, 8, ' ')
            || '  ' || strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%d') || '  ' || path AS line FROM nodes WHERE path IS NOT NULL"""),
    ),
}
