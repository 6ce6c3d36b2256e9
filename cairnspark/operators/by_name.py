"""Scalar operators as registered queries: the column functions over whole tables, and what they give written anew for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.api import transfers
from cairnspark.functions import columns as c
from cairnspark.sources.fixtures import duck, frame


def _files(make):
    return lambda s, d: frame(s, d, "files").select("id", *(f.alias(k) for k, f in make()))


def _table(name: str, key: str, make):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet").select(key, *(f.alias(k) for k, f in make()))


_JUNK_DUCK = "regexp_matches({x}, '^([.]DS_Store|[.]_.*|Thumbs[.]db|ehthumbs[.]db|desktop[.]ini|[.]Spotlight-V100|[.]Trashes|[.]fseventsd|[.]TemporaryItems|[$]RECYCLE[.]BIN|System Volume Information)$')"
_TYPED = "CASE id % 5 WHEN 0 THEN '~/' || name WHEN 1 THEN folder || '/../x/./' || name WHEN 2 THEN '  /a/../../' || name || ' ' WHEN 3 THEN 'no/' || name ELSE '~' END"
_UNITS = "CASE WHEN {n} < 1000 THEN {n} || ' B'" + "".join(
    f" WHEN {{n}} < {1000 ** (k + 1)} THEN CASE WHEN {{n}} < {10 * 1000**k} THEN printf('%.1f', {{n}} / {1000**k}.0::DOUBLE) ELSE printf('%.0f', {{n}} / {1000**k}.0::DOUBLE) END || ' {u}'"
    for k, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB"), (5, "PB"))
) + " END"
_LAST = "CASE WHEN regexp_extract(rtrim({x}, '/\\'), '[^/\\\\]*$') = '' THEN {x} ELSE regexp_extract(rtrim({x}, '/\\'), '[^/\\\\]*$') END"

QUERIES = {
    "c02_expand": (
        _files(lambda: [("expanded", c.expand(F.col("name")))]),
        duck(r"""SELECT id, array_to_string([name] || flatten(list_filter(list_transform(list_filter(string_split_regex(name, '[^\p{L}\p{N}]+'), lambda r: r <> ''),
            lambda r: string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' ')),
            lambda p: len(p) > 1)), ' ') AS expanded FROM files"""),
    ),
    "c10_human_bytes": (
        _files(lambda: [*((k, c.human_bytes(F.col("size") * m)) for k, m in (("b", 1), ("k", 50), ("m", 12_500), ("g", 1_000_000), ("t", 250_000_000), ("p", 500_000_000_000)))]),
        duck("SELECT id, " + ", ".join(f"{_UNITS.format(n=f'(size * {m})')} AS {k}" for k, m in (("b", 1), ("k", 50), ("m", 12_500), ("g", 1_000_000), ("t", 250_000_000), ("p", 500_000_000_000))) + " FROM files"),
    ),
    "c11_duration": (
        _files(lambda: [("short", c.human_duration((F.col("size") / 40).cast("double"))), ("long", c.human_duration((F.col("size") * 3).cast("double"))), ("none", c.human_duration((F.col("id") - 1500).cast("double")))]),
        duck("SELECT id, " + ", ".join(
            f"CASE WHEN {x} < 0 THEN '' WHEN {x} < 90 THEN greatest(1, CAST(floor({x} + 0.5) AS BIGINT)) || 's' WHEN {x} < 5400 THEN CAST(floor({x} / 60 + 0.5) AS BIGINT) || 'm' ELSE CAST(floor({x} / 3600) AS BIGINT) || 'h ' || CAST(floor(({x} - floor({x} / 3600) * 3600) / 60 + 0.5) AS BIGINT) || 'm' END AS {k}"
            for k, x in (("short", "(size::DOUBLE / 40)"), ("long", "(size * 3)::DOUBLE"), ("none", "(id - 1500)::DOUBLE"))) + " FROM files"),
    ),
    "c13_windows_name": (
        _table("pages", "page_id", lambda: [("safe", c.windows_name(F.col("url"))), ("device", c.windows_name(F.concat(F.element_at(F.array(*map(F.lit, ("con", "COM0", "lpt9.x", "", "nul .", "a\\b"))), (F.pmod(F.col("page_id"), F.lit(6)) + 1).cast("int")))))]),
        r"""WITH u AS (SELECT page_id, url, ['con', 'COM0', 'lpt9.x', '', 'nul .', 'a\b'][page_id % 6 + 1] AS v FROM pages), t AS (SELECT page_id, rtrim(translate(url, '<>:"\|?*', '________'), '. ') AS a, rtrim(translate(v, '<>:"\|?*', '________'), '. ') AS b FROM u),
            n AS (SELECT page_id, CASE a WHEN '' THEN '_' ELSE a END AS a, CASE b WHEN '' THEN '_' ELSE b END AS b FROM t)
            SELECT page_id, CASE WHEN upper(split_part(a, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_full_match(upper(split_part(a, '.', 1)), '(COM|LPT)[0-9]') THEN '_' || a ELSE a END AS safe,
            CASE WHEN upper(split_part(b, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_full_match(upper(split_part(b, '.', 1)), '(COM|LPT)[0-9]') THEN '_' || b ELSE b END AS device FROM n""",
    ),
    "c15_paths": (
        _files(lambda: [("depth", F.size(c.parts(F.col("path"))).cast("long")), ("up", c.parent(F.col("path"))), ("base", c.base_name(F.col("path"))), ("top", c.parent(F.lit("/x"))), ("inside", c.below(F.col("path"), F.concat(F.lit("/Library/"), F.lit("en"))))]),
        duck("SELECT id, CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth, left(path, length(path) - length(name) - 1) AS up, name AS base, '/' AS top, path LIKE '/Library/en/%' AS inside FROM files"),
    ),
    "c16_typed_path": (
        lambda s, d: frame(s, d, "files").select("id", c.typed_path(F.expr(_TYPED), "/home/me").alias("t")).select("id", "t.path", "t.error"),
        duck("""SELECT id, CASE id % 5 WHEN 0 THEN '/home/me/' || name WHEN 1 THEN '/Library/' || project || '/x/' || name WHEN 2 THEN '/' || name WHEN 4 THEN '/home/me' END AS path,
            CASE id % 5 WHEN 3 THEN 'Type a full path, starting with / or ~ (not “no/' || name || '”).' END AS error FROM files"""),
    ),
    "c18_cloud_name": (
        lambda s, d: frame(s, d, "files").select("id", c.cloud_name(F.expr("CASE id % 5 WHEN 0 THEN 'Box-Box' WHEN 1 THEN 'GoogleDrive-' || name WHEN 2 THEN 'Dropbox' WHEN 3 THEN 'OneDrive-Acme-x' ELSE source || '-' END")).alias("said")),
        duck("SELECT id, CASE id % 5 WHEN 0 THEN 'Box' WHEN 1 THEN 'Google Drive (' || name || ')' WHEN 2 THEN 'Dropbox' WHEN 3 THEN 'OneDrive (Acme-x)' ELSE source END AS said FROM files"),
    ),
    "c26_first_digest": (
        _files(lambda: [("digest", c.first_digest(F.expr("CASE id % 4 WHEN 0 THEN upper(sha256) || '  ' || name WHEN 1 THEN '\n ' || sha256 WHEN 2 THEN substring(sha256, 2) ELSE '' END")))]),
        duck("SELECT id, CASE WHEN id % 4 < 2 THEN sha256 END AS digest FROM files"),
    ),
    "c28_tar_number": (
        _files(lambda: [("octal", c.tar_number(F.encode(F.concat(F.lpad(F.conv(F.col("size"), 10, 8), 11, "0"), F.lit(" ")), "utf-8"))),
               ("base256", c.tar_number(F.unhex(F.concat(F.lit("80000000"), F.lpad(F.hex(F.col("size") * 9_000_000_007), 16, "0")))))]),
        duck("SELECT id, size AS octal, size * 9000000007 AS base256 FROM files"),
    ),
    "c29_ids": (
        _files(lambda: [("n", F.length(c.random_id(16)).cast("long")), ("hex", c.random_id(16).rlike("^[0-9a-f]{32}$")), ("stable", c.stable_id(F.col("path")))]),
        duck("SELECT id, CAST(32 AS BIGINT) AS n, true AS hex, left(sha256(path), 32) AS stable FROM files"),
    ),
    "c30_errors": (
        lambda s, d: frame(s, d, "job_events").selectExpr("event_id", "element_at(array('not_found', 'verify', 'io', 'other', 'signed_out'), CAST(event_id % 5 + 1 AS INT)) AS kind", "CASE WHEN event_id % 2 = 0 THEN 'lost the connection to x' ELSE 'a lost the connection' END AS message")
        .select("event_id", c.error_kind(F.col("kind")).alias("told"), c.is_lost(F.col("kind"), F.col("message")).alias("lost")),
        duck("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'verify' ELSE 'other' END AS told, event_id % 10 = 8 AS lost FROM job_events"),
    ),
    "c32_fold_accents": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(c.fold_accents("text")).alias("folded")),
        "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents",
    ),
    "c33_completion": (
        lambda s, d: frame(s, d, "files").groupBy("folder").agg(F.collect_list("name").alias("names")).select("folder", *(c.completion(F.lit(t), F.col("names")).alias(k) for k, t in (("a", "run1"), ("b", "RUN"), ("n", "zzz")))),
        duck("SELECT folder, " + ", ".join(f"""CASE WHEN len({k}) = 0 THEN NULL WHEN len({k}) = 1 THEN {k}[1] ELSE (SELECT CASE WHEN length(p) > length('{t}') THEN p ELSE '{t}' END FROM (SELECT list_reduce(CASE WHEN len({k}) = 0 THEN [''] ELSE {k} END,
            lambda x, y: list_aggregate(list_filter(list_transform(range(0, least(length(x), length(y)) + 1), lambda i: x[1:i]), lambda p: starts_with(y, p)), 'max')) AS p)) END AS {k}""" for k, t in (("a", "run1"), ("b", "RUN")))
             + """, CAST(NULL AS VARCHAR) AS n FROM (SELECT folder, coalesce(list(name) FILTER (WHERE name LIKE 'run1%'), []) AS a, list(name) AS b FROM files GROUP BY folder)"""),
    ),
    "c34_titles": (
        lambda s, d: frame(s, d, "files").select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'send' ELSE 'retrieve' END").alias("direction"), F.expr("CASE WHEN id % 2 = 0 THEN 'move' ELSE 'copy' END").alias("mode"),
                                                 F.expr("CASE WHEN id % 4 = 0 THEN array(path, folder, 'x') ELSE array(path || '/') END").alias("sources"), F.expr("CASE WHEN id % 5 = 0 THEN '/' ELSE folder || '/' END").alias("dest"), "project")
        .select("id", c.transfer_title(F.col("direction"), F.col("mode"), F.col("sources"), F.col("dest"), F.col("project")).alias("title"),
                c.copy_title(F.col("mode"), F.col("sources"), F.when(F.col("id") % 7 == 0, F.col("project")), F.when(F.col("id") % 2 == 1, F.lit("there")), F.col("dest")).alias("copied")),
        duck("""SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'Moving ' WHEN id % 3 = 0 THEN 'Copying ' ELSE 'Retrieving ' END || name || CASE WHEN id % 4 = 0 THEN ' and 2 more' ELSE '' END || ' → ' || CASE WHEN id % 5 = 0 THEN project ELSE source END AS title,
            CASE WHEN id % 2 = 0 THEN 'Moving ' ELSE 'Copying ' END || name || CASE WHEN id % 4 = 0 THEN ' and 2 more' ELSE '' END || CASE WHEN id % 7 = 0 THEN ' from ' || project ELSE '' END || ' → '
            || CASE WHEN id % 2 = 1 THEN rtrim('there ' || CASE WHEN id % 5 = 0 THEN '' ELSE source END) ELSE CASE WHEN id % 5 = 0 THEN '' ELSE source END END AS copied FROM files"""),
    ),
    "f05_terms": (
        lambda s, d: frame(s, d, "files").where(c.name_matches(F.col("name"), ["RUN1", "sample", "*.t?t"])).select("id"),
        duck("SELECT id FROM files WHERE lower(name) LIKE '%run1%' AND name ILIKE '%sample%' AND name ILIKE '%.t_t'"),
    ),
    "f08_glob": (
        _files(lambda: [*((k, c.glob(F.col("name"), p)) for k, p in (("a", "run*_src?Sample.*"), ("b", "*.gz"), ("n", "run"), ("dot", "*.tx.")))]),
        duck("SELECT id, name LIKE 'run%\\_src_Sample.%' ESCAPE '\\' AS a, ends_with(name, '.gz') AS b, name = 'run' AS n, name LIKE '%.tx.' AS dot FROM files"),
    ),
    "f09_excluded": (
        lambda s, d: frame(s, d, "files").withColumn("n", F.expr("CASE id % 5 WHEN 0 THEN '._' || name WHEN 1 THEN 'Thumbs.db' WHEN 2 THEN '$RECYCLE.BIN' ELSE name END")).select("id", c.excluded(F.col("n")).alias("junk"), c.excluded(F.col("n"), ("*.pdf", "run?_*")).alias("out")),
        duck(f"""SELECT id, {_JUNK_DUCK.format(x='n')} AS junk, {_JUNK_DUCK.format(x='n')} OR n LIKE '%.pdf' OR n LIKE 'run_\\_%' ESCAPE '\\' AS out
            FROM (SELECT id, CASE id % 5 WHEN 0 THEN '._' || name WHEN 1 THEN 'Thumbs.db' WHEN 2 THEN '$RECYCLE.BIN' ELSE name END AS n FROM files)"""),
    ),
    "f21_protected": (
        lambda s, d: frame(s, d, "files").select("id", c.protected_path(F.expr("CASE id % 4 WHEN 0 THEN '/' || source WHEN 1 THEN '/home' || '/me' WHEN 2 THEN '/' ELSE path END"), "/home/me").alias("why")),
        duck("SELECT id, CASE WHEN id % 4 IN (0, 2) THEN 'that is the top level of a disk, not something to delete' WHEN id % 4 = 1 THEN 'that holds your home folder' END AS why FROM files"),
    ),
    "f22_overlap": (
        lambda s, d: (lambda f: f.select(F.col("folder").alias("a")).distinct().crossJoin(F.broadcast(f.selectExpr("'/Library/' || project || '/' AS b").distinct())).where(c.overlap(F.col("a"), F.col("b")) | c.overlap(F.col("b"), F.col("a"))))(frame(s, d, "files")),  # a handful of projects
        duck("SELECT a, b FROM (SELECT DISTINCT folder AS a FROM files) JOIN (SELECT DISTINCT '/Library/' || project || '/' AS b FROM files) ON a = rtrim(b, '/') OR starts_with(a, b) OR starts_with(rtrim(b, '/'), a || '/')"),
    ),
    "f23_allowed": (
        lambda s, d: frame(s, d, "job_events").select("event_id", c.allowed(F.expr("element_at(array('list', 'rename', 'put', 'key_list', 'trash', 'read', 'init'), CAST(event_id % 7 + 1 AS INT))")).alias("ok")),
        duck("SELECT event_id, event_id % 7 IN (0, 2, 5) AS ok FROM job_events"),
    ),
    "f24_incompressible": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", c.incompressible(F.encode(F.rpad(F.lit(""), 5000, "ab"), "utf-8")).alias("plain"), c.incompressible(F.unhex(F.concat(*(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"-{k}")), 512) for k in range(80))))).alias("noise"), c.incompressible(F.encode(F.lit("short"), "utf-8")).alias("short")),
        "SELECT doc_id, false AS plain, true AS noise, false AS short FROM documents",
    ),
    "f25_states": (
        lambda s, d: frame(s, d, "jobs").select("job_id", transfers.active(F.col("state")).alias("moving"), transfers.unfinished(F.col("state")).alias("open"), transfers.finished(F.col("state")).alias("over")),
        duck("SELECT job_id, state = 'queued' OR state = 'running' OR state = 'waiting' AS moving, state NOT IN ('done', 'failed', 'cancelled', 'interrupted') AS open, state IN ('done', 'failed', 'cancelled') AS over FROM jobs"),
    ),
    "f28_valid_name": (
        _table("pages", "page_id", lambda: [("valid", c.valid_name(F.col("url"))), ("top", c.valid_name(F.element_at(F.array(*map(F.lit, (".archive", "a", "..", "x" * 256, "é" * 128))), (F.pmod(F.col("page_id"), F.lit(5)) + 1).cast("int")), F.lit(True)))]),
        "SELECT page_id, NOT (url LIKE '%/%' OR strlen(url) > 255 OR url IN ('', '.', '..')) AS valid, page_id % 5 = 1 AS top FROM pages",
    ),
}
