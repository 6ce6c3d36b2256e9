"""The search language and the greedy batches, against literal expectations."""

import pytest

from cairnspark.functions.search_language import filter_of, parse, size_of, start_of
from cairnspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("text", "want"), [("2.5tb", 2_500_000_000_000), ("750kb", 750_000), ("12m", 12_000_000), ("7", 7), ("2kib", 2000), ("1.2.3", None), (".", None), ("5x", None), ("", None)])
def test_sizes(text, want):
    assert size_of(text) == want


@pytest.mark.parametrize(("text", "want"), [("1970", 0), ("1970-02", 31 * 86400), ("2023-02-31", 1677801600), ("2023-03-03", 1677801600), ("1899", None), ("2023-13", None), ("2023-x", None), ("", None)])
def test_dates(text, want):
    assert start_of(text) == want


def test_filters():
    assert filter_of("Type:..CSV") == ("ext", "csv") and filter_of("ext:") is None
    assert filter_of("is:Dir") == ("kind", "d") and filter_of("is:files") == ("kind", "f") and filter_of("is:odd") is None
    assert filter_of(">=1k") == ("size", ">=", 1000) and filter_of("size:<2") == ("size", "<", 2) and filter_of("size:2") is None


def test_parse():
    got = parse(' maple "two  words" is:odd type:csv after:2023 "" "open end')
    assert got.words == ["maple", "is:odd"] and got.phrases == ["two  words", "open end"]
    assert got.filters == [("ext", "csv"), ("after", 1672531200)]
    assert parse("  ") == parse("")


@pytest.mark.parametrize(("name", "small", "closed"), [
    ("w09_solid_blocks", True, lambda n, pos, size: pos >= 6400),
    ("w10_retrieval_batches", False, lambda n, pos, size: n >= 20 or pos + size > 51200),
])
def test_batches(spark, name, small, closed):
    import duckdb

    rows = duckdb.sql(f"select '/Library/' || lang || '/' || source, doc_id + 1000, strlen(text) from '{SF}/documents.parquet' order by 1, 2").fetchall()
    want, at = [], {}
    for folder, item, size in rows:
        if small and size > 2000:
            continue
        n, pos, no = at.get(folder, (0, 0, 0))
        if n and closed(n, pos, size):
            n, pos, no = 0, 0, no + 1
        at[folder] = n + 1, pos + size, no
        want.append((folder, item, no))
    assert sorted(map(tuple, registry.queries()[name](spark, SF).select("folder", "id", "batch_no").collect())) == sorted(want)
