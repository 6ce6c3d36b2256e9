"""Every operator and pipeline stage on awkward tables: null, empty, very long, tied and repeated rows, clashing columns, ids of other types, no rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from cairnspark.llm import bpe, decontaminate, licenses, minhash, pii, simhash, suffix_dedup, suffix_tree, toxicity, urls

SF = "/root/testdata/sf0.001"
TOKENS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
BIG = 2**60 + 1  # a fraction cannot hold it
#: Names that operators use inside.
CLASH = ("block", "k", "low", "fp", "train", "cands", "w", "h", "hash", "range", "at", "to", "tops", "spans", "part", "name", "size", "n", "same", "word", "score", "toxic", "item_id", "row", "_l", "_rules", "shard", "root", "node")
LONG = "lorem ipsum dolor sit amet a@b.com " * 20_000
TEXTS = (None, "", " \n", "one", "Ünïcode 😀 \u0000 \x85", "same text of some words here", "same text of some words here", "MIT License", "you stupid hateful vermin trash idiots " * 3, "x" * 9000)


def _rows(ids):
    rows = [(ids(i), t) for i, t in enumerate(TEXTS)]
    return rows + [(None, "no id"), (None, "no id"), (None, None), (ids(5), "same text of some words here"), (ids(5), "another text with the same id"), (ids(50), LONG)]


KINDS = {"long": ("long", lambda i: BIG + i), "text": ("string", lambda i: f"id-{i}")}


def _docs(spark, kind="long"):
    sql, ids = KINDS[kind]
    d = spark.createDataFrame(_rows(ids), f"doc_id {sql}, text string")
    return d.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})


def _labels(spark, kind="long"):
    sql, ids = KINDS[kind]
    rows = [(ids(i), 1, int(i == 8)) for i in range(10)] + [(None, 0, 1), (ids(3), 1, None), (ids(3), 1, 0)]
    return spark.createDataFrame(rows, f"doc_id {sql}, quality int, toxic int")


def _items(spark):
    return spark.createDataFrame([(1, "same text of some words here"), (None, "a question that nobody asks? no"), (2, None), (2, ""), (3, "word " * 900)], "item_id long, text string")


#: One row out for each row in.
EACH = {
    "op1": lambda s, d, k: suffix_tree.score_documents(d), "op2": lambda s, d, k: pii.find_pii(d), "op3": lambda s, d, k: minhash.fingerprint_edits(d),
    "op3 signatures": lambda s, d, k: minhash.signatures(d), "op3 classes": lambda s, d, k: minhash.near_classes(d), "op5": lambda s, d, k: simhash.near_classes(d),
    "op6": lambda s, d, k: toxicity.judge(d, _labels(s, k)), "op7": lambda s, d, k: suffix_dedup.remove_repeats(d), "op9": lambda s, d, k: bpe.round_trip(d, *TOKENS),
    "op9 encode": lambda s, d, k: bpe.encode_texts(d, *TOKENS), "op9 decode": lambda s, d, k: bpe.decode_ids(bpe.encode_texts(d, *TOKENS), *TOKENS), "op10": lambda s, d, k: licenses.scan_licenses(d),
}
#: Documents out, with their columns.
STAGES = {
    "toxicity": lambda s, d, k: toxicity.keep_clean(d, _labels(s, k)), "dedup": lambda s, d, k: simhash.dedup(d), "decontamination": lambda s, d, k: decontaminate.keep_clean(d, _items(s)), "pii": lambda s, d, k: pii.redact(d),
}
OTHER = {"op4": lambda s, d, k: decontaminate.retrieve(d, _items(s)), "op3 pairs": lambda s, d, k: minhash.near_duplicates(d)}


def _bag(df):
    return collections.Counter(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", EACH)
def test_each_row_has_its_result(spark, name, kind):
    d = _docs(spark, kind)
    got = EACH[name](spark, d, kind)
    assert got.schema["doc_id"].dataType == d.schema["doc_id"].dataType
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(got) == ids(d)
    values = [c for c in got.columns if c not in ("doc_id", "component_id", "class_id", "first_word", "last_word")]
    assert all(r[c] is not None for r in got.collect() for c in values)


@pytest.mark.parametrize("name", [*EACH, *OTHER])
def test_clashing_columns_and_repeated_runs_change_nothing(spark, name):
    run = (EACH | OTHER)[name]
    d = _docs(spark)
    more = d.select("*", *(F.lit(1).alias(c) for c in CLASH)).repartition(3)
    assert _bag(run(spark, d, "long")) == _bag(run(spark, more, "long"))


@pytest.mark.parametrize("name", STAGES)
@pytest.mark.parametrize("kind", KINDS)
def test_stages_keep_columns_and_only_lose_what_they_reject(spark, name, kind):
    d = _docs(spark, kind).select("*", *(F.lit(1).alias(c) for c in CLASH))
    out = STAGES[name](spark, d, kind)
    assert out.schema.names == d.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
    got, had = (collections.Counter((r.doc_id, r.text or "") for r in x.collect()) for x in (out, d))
    if name == "toxicity":
        assert not got - had and {t for _, t in (had - got)} <= {TEXTS[8]}
    elif name == "dedup":
        assert not got - had and {t.strip() for _, t in got} == {t.strip() for _, t in had} and max(got.values()) == 1
    elif name == "decontamination":
        assert not got - had and {t for _, t in had - got} == {TEXTS[5]}
    else:
        assert sum(got.values()) == sum(had.values()) and "[EMAIL]" in next(t for _, t in got if len(t) > 100_000)
        assert all(r.n_chars == len(r.text) for r in out.collect())


@pytest.mark.parametrize("name", [*EACH, *STAGES, *OTHER])
def test_no_rows(spark, name):
    d = _docs(spark)
    out = (EACH | STAGES | OTHER)[name](spark, d.where("false"), "long")
    assert out.collect() == []


def test_no_items_and_no_labels(spark):
    d = _docs(spark)
    assert decontaminate.retrieve(d, _items(spark).where("false")).collect() == []
    assert decontaminate.keep_clean(d, _items(spark).where("false")).count() == d.count()
    for labels in (_labels(spark).where("false"), _labels(spark).where("toxic = 0")):
        got = toxicity.judge(d, labels).collect()
        assert len(got) == d.count() and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1


def test_urls_on_awkward_rows(spark):
    made = [(BIG, None), (BIG, ""), (None, "http://EXAMPLE.com/en/7?x"), (None, None), (BIG + 1, "no scheme"), (BIG + 2, "x://" + "a" * 50_000), (BIG + 3, "http://sub.example.net/de/8"), (BIG + 3, "http://sub.example.net/de/8")]
    d = spark.createDataFrame(made, "page_id long, url string").withColumns({c: F.lit("z") for c in ("u", "rest", "host", "path", "rule")})
    got = urls.judge_urls(d).collect()
    assert collections.Counter(r.page_id for r in got) == collections.Counter(i for i, _ in made)
    assert {(r.host, r.path) for r in got if r.page_id == BIG} == {("", "")} and all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge_urls(d.where("false")).collect() == []


def test_signatures_and_codes_by_hand(spark):
    d = _docs(spark)
    texts = collections.defaultdict(set)
    for r in d.collect():
        texts[r.doc_id].add(r.text or "")
    for r in minhash.signatures(d).collect():
        assert r.fingerprint in {minhash.signature(minhash.Shingler()(t)).tobytes().hex() for t in texts[r.doc_id]}
    import tiktoken

    encoding = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(TOKENS[0]), special_tokens={})
    for r in bpe.encode_texts(d, *TOKENS).collect():
        assert tuple(r.ids) in {tuple(encoding.encode_ordinary(t)) for t in texts[r.doc_id]}
    assert all(r.text in texts[r.doc_id] for r in bpe.decode_ids(bpe.encode_texts(d, *TOKENS), *TOKENS).collect())


def test_pipeline_stage_by_stage(spark):
    """Each stage's result by a plain version of what it decides, on all that the one before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {i for i, r in rows.items() if model.score(r.text or "") < 0.3}
    made = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r.doc_id for r in made.collect()} == clean
    prints = {i: simhash.fingerprint(rows[i].text or "") for i in clean}
    group = {i: i for i in clean}
    for _ in clean:  # links within three bits, to the least id
        new = {i: min(group[j] for j in clean if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in clean}
        if new == group:
            break
        group = new
    kept = set(group.values())
    made = corpus_pipeline.drop_near_copies(spark, made, SF)
    assert {r.doc_id for r in made.collect()} == kept
    items = [re.findall(r"[^\W_]+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    asked = [grams(w) for w in items if w]
    whole = {i: grams(re.findall(r"[^\W_]+", (rows[i].text or "").lower())) for i in kept}
    quoted = {i for i in kept if any(len(a & whole[i]) >= 0.8 * len(a) for a in asked)}
    made = corpus_pipeline.drop_contaminated(spark, made, SF)
    left = {r.doc_id for r in made.collect()}
    assert left <= kept - quoted and all(any(a & whole[i] for a in asked) for i in kept - quoted - left)
    out = {r.doc_id: r.text for r in corpus_pipeline.redact_pii(spark, made, SF).collect()}
    assert out.keys() == left
    for i, t in out.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
        pieces = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|SSN|IBAN|SECRET)\]", t)
        at = [(rows[i].text or "").find(p) for p in pieces]
        assert min(at) >= 0  # what is not redacted is as it was
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == left


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


