"""Catalog queries against the other engine on the smallest tables, and literal expectations."""

import hashlib

import duckdb
import hypothesis
import pandas as pd
import pytest
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cairnspark.api import changes, search, transfers
from cairnspark.functions import columns as c
from cairnspark.functions import names
from cairnspark.operators import by_source
from cairnspark.plans import registry
from cairnspark.plans.dialect import Duck, Spark
from cairnspark.sources import seekable, shared, tar

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "labels")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(frame: pd.DataFrame) -> list:
    cols = sorted(frame.columns)
    return sorted(tuple("None" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_oracle(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def _column(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("name", "want"),
    [("MapleGrove1987.zip", "MapleGrove1987.zip Maple Grove 1987"), ("set9_Probe", "set9_Probe set 9"), ("RNAPlate", "RNAPlate RNA Plate"), ("plain.tar.gz", "plain.tar.gz"), ("ÉtéHiver", "ÉtéHiver Été Hiver")],
)
def test_expand(spark, name, want):
    assert _column(spark, c.expand, name) == want


@pytest.mark.parametrize(("name", "want"), [("a.txt", "a (2).txt"), (".hidden", ".hidden (2)"), ("b.tar.gz", "b.tar (2).gz"), ("c", "c (2)")])
def test_numbered(spark, name, want):
    q = name.replace("'", "''")
    a = spark.sql(f"SELECT {names.numbered(Spark(''), 'x', '2')} AS y FROM (SELECT '{q}' AS x) t").first().y
    b = duckdb.sql(f"SELECT {names.numbered(Duck(), 'x', '2')} AS y FROM (SELECT '{q}' AS x) t").fetchall()[0][0]
    assert a == b == want
    row = changes.free_names(spark.createDataFrame([(1, f"/d/{name}")], "id long, path string"), spark.createDataFrame([], "path string")).first()
    assert row.free == f"/d/{want}" and row.n == 2


@pytest.mark.parametrize(("name", "want"), [("q:r?.txt", "q_r_.txt"), ("aux.log", "_aux.log"), ("end. . ", "end"), ("fine", "fine"), ("COM0", "_COM0"), ("lpt5.x.y", "_lpt5.x.y"), ("a\\b/c", "a_b/c"), ("", "_"), (" . ", "_"), ("COM10", "COM10")])
def test_windows_names(spark, name, want):
    assert _column(spark, c.windows_name, name) == want


@pytest.mark.parametrize(
    ("size", "want"),
    [(0, "0 B"), (999, "999 B"), (1000, "1.0 KB"), (2250, "2.2 KB"), (2350, "2.4 KB"), (9960, "10.0 KB"), (12_500, "12 KB"), (13_500, "14 KB"), (1_500_000, "1.5 MB"), (3 * 10**9, "3.0 GB"), (7 * 10**12, "7.0 TB"), (2 * 10**15, "2.0 PB"), (4321 * 10**15, "4321 PB")],
)
def test_human_bytes(spark, size, want):
    assert _column(spark, c.human_bytes, size, "bigint") == want


@pytest.mark.parametrize(("seconds", "want"), [(0.2, "1s"), (89.4, "89s"), (89.5, "90s"), (90.0, "2m"), (5399.0, "90m"), (5400.0, "1h 30m"), (7199.0, "1h 60m"), (-1.0, ""), (float("inf"), "")])
def test_human_duration(spark, seconds, want):
    assert _column(spark, c.human_duration, seconds, "double") == want


@pytest.mark.parametrize(("days", "want"), [(-719_542, "-1-12-18"), (-719_528, "0000-01-01"), (-719_529, "-1-12-31"), (-1_084_771, "-1001-12-31"), (-719_162, "0001-01-01"), (-354_286, "0999-12-31"), (0, "1970-01-01"), (2_932_896, "9999-12-31"), (2_932_897, "10000-01-01"), (-40_000_000, "-107547-09-20"), (None, None)])
def test_day_text(spark, days, want):
    assert _column(spark, lambda x: c.day_text(F.date_from_unix_date(x)), days, "int") == want
    assert duckdb.sql(f"SELECT strftime(DATE '1970-01-01' + CAST({'NULL' if days is None else days} AS INTEGER), '%Y-%m-%d')").fetchall()[0][0] == want


def test_typed_paths(spark):
    cases = {"~": "/h/u", "~/a/../b": "/h/u/b", " /x/./y/ ": "/x/y", "/../../z": "/z", "rel": None}
    for typed, want in cases.items():
        got = _column(spark, lambda x: c.typed_path(x, "/h/u"), typed)
        assert got.path == want and (got.error is None) == (want is not None)


def test_search_ranks_names_above_folders(spark):
    """A small catalog: words in names or folders, accents, pieces, phrases, filters, folders found too, odd input."""
    files = [("/Work/Silver_Birch/in/run7_Probe.fastq.gz", 3 * 10**9, 1_700_000_000), ("/Work/Silver_Birch/out/peak_calls.csv", 5_000_000, 1_710_000_000), ("/Work/SilverBirch2021/notes.txt", 2_000, 1_600_000_000), ("/Else/Études/leçon.pdf", 90_000, 1_650_000_000)]
    schema = "id bigint, parent bigint, path string, name string, kind string, project string, sha256 string, size bigint, mtime_ns bigint, created bigint, trashed_at bigint, trash_origin string"
    root = spark.createDataFrame([(1, None, "/", "", "d", None, None, 0, 0, 0, None, None), (2, None, None, ".trash", "d", None, None, 0, 0, 0, None, None)], schema)
    n = changes.mkdirs(root, spark.createDataFrame([(p.rsplit("/", 1)[0],) for p, *_ in files], "path string"), 0)
    n = n.select(root.columns).union(spark.createDataFrame([(10 + i, 3, p, p.rsplit("/", 1)[1], "f", None, None, s, t * 10**9, 0, None, None) for i, (p, s, t) in enumerate(files)], schema))
    n = changes.set_totals(n).cache()
    index = search.word_index(n).cache()

    def found(q, limit=100):
        return [r.path for r in search.search(n, index, q, limit).collect()]

    assert found("birch fastq") == [files[0][0]] and found("peak") == [files[1][0]] and found("2021 notes") == [files[2][0]] and found("etudes lecon") == [files[3][0]]
    assert found("silver")[0] in ("/Work/Silver_Birch", "/Work/SilverBirch2021") and found("type:csv") == [files[1][0]] and found("type:fastq") == [files[0][0]]
    assert found("silver >1GB is:file") == [files[0][0]] and found("silver is:file before:2021") == [files[2][0]] and found("is:folder in") == ["/Work/Silver_Birch/in"]
    assert found('"Silver Birch" out is:folder') == ["/Work/Silver_Birch/out"] and found("no-such") == [] and found("  ") == [] and found('" * AND OR ( ^') == []
    assert set(found("is:folder >1GB")) == {"/Work", "/Work/Silver_Birch", "/Work/Silver_Birch/in"}
    assert len(found("silver", 2)) == 2


def test_search_without_a_limit_gives_all(spark):
    """More hits than the server's limit, by a word and by a filter alone; the queries that state all hits use no limit."""
    n = spark.range(10, 1_310).selectExpr("id", "3L AS parent", "'/a/x' || id AS path", "'x' || id AS name", "'f' AS kind", "'a' AS project", "id AS size", "0L AS mtime_ns", "CAST(NULL AS BIGINT) AS trashed_at").cache()
    index = search.word_index(n)
    assert search.search(n, index, "x", None).count() == search.search(n, index, "size:>1", None).count() == 1_300
    assert search.search(n, index, "x", 5_000).count() == search.search(n, index, "size:>1", 5_000).count() == 1_000


def test_src1_has_every_entry(spark, tmp_path):
    """j02_search_entries over more files than the limit: the SQL has none."""
    spark.range(1_200).selectExpr("id AS doc_id", "'t' || id AS text", "'en' AS lang", "'src1' AS source", "3L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["j02_search_entries"](spark, str(tmp_path)).toPandas()
    assert len(got) > 1_000 and _rows(got) == _rows(c.sql(registry.oracle_sql()["j02_search_entries"]).df())


def test_speed_keeps_a_baseline_and_starts_anew(spark):
    rows = [(1, 0.0, 0), (2, 0.3, 30), (3, 1.0, 100), (4, 6.0, 700), (5, 12.0, 1000), (6, 13.0, 50), (7, 13.2, 60), (8, 14.0, 250)]
    d = spark.createDataFrame([(1, *r) for r in rows], "job_id long, event_id long, secs double, total long")
    got = {r.event_id: r.rate for r in transfers.speed(d, 5.0).collect()}
    assert got == {1: 0, 2: 0, 3: 100, 4: 120, 5: 50, 6: 0, 7: 0, 8: 200}


@hypothesis.settings(max_examples=40, deadline=None)
@hypothesis.given(st.binary(max_size=5000), st.integers(1, 900), st.integers(0, 5200), st.integers(0, 5200))
def test_seekable_round_trip(data, frame, start, size):
    stream = seekable.compress(data, frame, 1)
    assert seekable.read(stream, start, size) == data[start : start + size]
    assert sum(f[4] for f in seekable.table_of(stream)) == len(data)


@pytest.mark.parametrize("spoil", [lambda b: b[:10], lambda b: b[:-1], lambda b: b[:-9] + b"\xff" * 4 + b[-5:], lambda b: b[1:], lambda b: b"x" + b])
def test_damaged_seek_tables_are_refused(spoil):
    with pytest.raises(ValueError, match="seek|short"):
        seekable.table_of(spoil(seekable.compress(b"some bytes" * 100, 300)))


def test_tar_round_trip(spark, tmp_path):
    odd = [("a/" + "long" * 60 + ".txt", b"1" * 5), ("résumé ü/日本.txt", b""), ("plain", b"z" * 20000), ("sp ace/tab\there", b"q")]
    rows = [(f"pack-{k % 2:08d}.tar", k, p, "f", 1_600_000_000 + k, 0o640, None, bytearray(b)) for k, (p, b) in enumerate(odd)]
    rows += [("pack-00000000.tar", 90, "dir", "d", 5, 0o755, None, None), ("pack-00000000.tar", 91, "link", "l", 5, 0o777, "plain", None)]
    d = spark.createDataFrame(rows, "pack string, seq int, path string, kind string, mtime bigint, mode int, target string, content binary")
    tar.write(d, str(tmp_path))
    got = {(r.pack, r.path): r for r in tar.read(spark, str(tmp_path), content=True).collect()}
    assert {(r[0], r[2]) for r in rows} == got.keys()
    for pack, _, path, kind, mtime, mode, target, content in rows:
        r = got[pack, path]
        assert (r.kind, r.mtime, r.mode, r.target) == (kind, mtime, mode, target) and (content is None or bytes(r.content) == bytes(content))
    assert not [f for f in tmp_path.rglob("*.tmp")]


@F.pandas_udf(IntegerType())
def _batch_rows(x: pd.Series) -> pd.Series:
    return pd.Series([len(x)] * len(x))


def _many(spark, n: int = 2000, size: int = 10_000):
    """Contents of 20 MB in one partition."""
    return spark.range(n).coalesce(1).select("id", F.unhex(F.repeat(F.md5(F.col("id").cast("string")), size // 16)).alias("data"))


def test_packs_travel_in_small_batches(spark, tmp_path):
    """Written and read: rows of a large partition come a few at a time, and the session's own bound is back afterwards."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    rows = _many(spark).select(F.lit("pack-00000001.tar").alias("pack"), F.col("id").cast("int").alias("seq"), F.format_string("%05d", "id").alias("path"), F.lit("f").alias("kind"), F.lit(1).cast("bigint").alias("mtime"), _batch_rows("data").alias("mode"), F.lit(None).cast("string").alias("target"), F.col("data").alias("content"))
    tar.write(rows, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "64m"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    reader = tar._Reader({"path": str(tmp_path), "content": "true"})
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert len(batches) > 4 and max(b.nbytes for b in batches) < 2 * shared.BATCH_BYTES and sum(b.num_rows for b in batches) == 2000
    got = tar.read(spark, str(tmp_path), content=True).select("seq", "mode", F.sha2("content", 256).alias("h")).collect()
    assert max(r.mode for r in got) < 1000
    assert {(r.seq, r.h) for r in got} == {(k, hashlib.sha256(hashlib.md5(str(k).encode()).digest() * 625).hexdigest()) for k in range(2000)}


def test_streams_travel_in_small_batches(spark):
    """s04_seek_table's way: contents to streams to tables, in a session whose own bound is large."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for use in (lambda x: seekable.compressed(x, 1000, 1), seekable.seek_table, lambda x: seekable.read_range(x, F.lit(0), F.lit(1))):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        use(F.col("x"))
        assert _many(spark).select(_batch_rows("data").alias("n")).agg(F.max("n")).first()[0] < 1000
    got = seekable.frames(_many(spark, 300).select("id", seekable.compressed(F.col("data"), 1000, 1).alias("stream")))
    assert got.count() == 3000 and got.agg(F.sum("d_len")).first()[0] == 3_000_000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    seekable.compressed(F.col("x"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """Documents whose ids are as large as in tables of some GB; the nanoseconds of their times are over a bigint."""
    where = tmp_path_factory.mktemp("late")
    duckdb.sql(f"copy (select * replace (doc_id + 3000000 as doc_id) from '{SF}/documents.parquet' where doc_id < 80) to '{where}/documents.parquet'")
    return str(where)


@pytest.mark.parametrize("name", ["k06_verified", "s14_pack_files", "s03_damaged_packs"])
def test_packs_of_late_files(spark, late, name):
    got = registry.queries()[name](spark, late).toPandas()
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{late}/documents.parquet'")
        want = con.sql(registry.oracle_sql()[name]).df()
    assert len(want) and _rows(got) == _rows(want)


def test_times_of_late_files_are_kept(spark, late):
    """Exact in the tar's headers, its manifest and its list of copies; asked for as a bigint they are an error."""
    where = by_source._packed(spark, late)
    secs = {f"run{k}_": 1704067200 + k * 3600 for k in range(3_000_000, 3_000_080)}
    told = tar.manifests(spark, where).select(F.explode("entries").alias("e")).select("e.*").collect()
    held = tar.read(spark, where).where("path NOT LIKE '.archive/%'").collect()
    of = lambda path: secs[path[path.rindex("/") + 1 :].split("_")[0] + "_"]
    assert len(told) == 80 and all(int(r.mtime_ns) == of(r.path) * 1_000_000_000 for r in told)
    assert held and all(r.mtime == of(r.path) for r in held)
    entries = tar.entries(tar.manifests(spark, where))
    assert entries.count() == 80
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        entries.select("mtime_ns").collect()


def test_rollup_invariants(spark):
    """A folder's totals are those of all files below it; each content has one carrier."""
    q = registry.queries()
    totals = {r.folder_path: r for r in q["a03_folder_totals"](spark, SF).collect()}
    measured = {r.project: r for r in q["a10_measure"](spark, SF).collect()}
    for project, r in measured.items():
        assert totals[f"Library/{project}"].bytes == r.bytes
        assert totals[f"Library/{project}"].n_files == r.n_files
    assert totals["Library"].n_files == sum(r.n_files for r in measured.values())
    assert q["w01_carrier"](spark, SF).where("carries").count() == q["a13_distinct_digests"](spark, SF).count()
