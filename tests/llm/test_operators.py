"""Each operator against a brute-force version on small tables, and on awkward rows."""

import collections
import fnmatch
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import public_tokenizers as P
from cairnspark.llm import bpe, components, decontaminate, licenses, minhash, pii, simhash, suffix_dedup, suffix_tree, toxicity, urls
from cairnspark.llm.common import words_of

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")
AWKWARD = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, "one"), (900005, "é😀 " * 300), (900006, "a" * 3000), (900007, "1 2 " * 3000),
    (900008, "x@@a@b.c_d@e.f 1.2.3.4.5.6 +1 (234) 567-8901 then 4111 1111 1111 1111 then 256.1.1.1"), (900009, "MIT License, mit license mit  license. Apache LICENSE"),
    (900010, "same text here"), (900010, "same text here"), (900011, "word " * 20000), (None, "no id at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in AWKWARD], d.schema)
    # extra columns with names that operators use inside
    return d.union(more).selectExpr("*", "1 AS block", "2 AS k", "'x' AS low", "3 AS fp", "4 AS train", "'y' AS cands").coalesce(2).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def _same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


EMPTY_CASES = {
    "tree": suffix_tree.score_documents, "pii": pii.find_pii, "minhash": minhash.fingerprint_edits, "simhash": simhash.near_classes,
    "repeats": suffix_dedup.remove_repeats, "bpe": lambda d: bpe.round_trip(d, PATH, P.PATTERN), "licenses": licenses.scan_licenses,
    "redact": pii.redact, "dedup": simhash.dedup,
}


@pytest.mark.parametrize("name", EMPTY_CASES)
def test_empty_table(docs, name):
    assert EMPTY_CASES[name](docs.where("doc_id < -5")).collect() == []


def test_licenses(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in rows:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        places = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = licenses.scan_licenses(docs).collect()
    _same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_licenses_in_other_spellings(spark):
    cases = [
        ("the figures are CC-BY-4.0", "cc-by"), ("Licensed under CC-BY-SA 4.0", "cc-by-sa"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by-nc"), ("CC BY SA 4.0", "cc-by-sa"),
        ("released under\nCC_BY_ND 4.0", "cc-by-nd"), ("Licensed under the Common\nPublic License", "cpl"), ("SIL Open-Font license", "ofl"), ("European-Union Public Licence v1.2", "eupl"),
        ("Common Development-and-Distribution License", "cddl"), ("All\nrights  reserved, licensed under All-Rights-Reserved", "proprietary"), ("placed in the public\ndomain", "public-domain"),
        ("Permission is hereby\ngranted, free of charge, to any person\nobtaining a copy", "mit"), ("this is accepted by all", ""), ("CC by hand", ""),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(d).collect()}
    assert {cases[i][0]: x for i, x in got.items()} == dict(cases)


def test_license_keywords_stand_in_their_rules():
    assert all(" " not in keyword and keyword in rx for keyword, rx, *_ in licenses.rules())


def _luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def _base_spans(t):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h, d: all(int(x) <= 255 for x in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h, d: 12 <= len(d) <= 19 and _luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h, d: 9 <= len(d) <= 15),
    )
    return sorted((m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(kinds) for m in re.finditer(rx, t) if ok(m.group(), re.sub("[^0-9]", "", m.group())))


def test_pii(docs, rows):
    want = [(i, hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in _base_spans(t)).encode()).hexdigest()) for i, t in rows]
    _same([(r.doc_id, r.base_sha256) for r in pii.find_pii(docs).collect()], want)


def test_redact_removes_base_spans(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert "a@b.c" not in got[900008] and "4111" not in got[900008] and got[900001] == ""


def test_minhash(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        sig = [minhash.signature(minhash.Shingler()(x)) for x in (t, edited, after)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sig[0].tobytes().hex(), minhash.likeness(sig[0], sig[1]), minhash.likeness(sig[0], sig[2])))
    got = minhash.fingerprint_edits(docs).collect()
    _same([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got], want)


def test_minhash_likeness_and_pairs(spark):
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w), " ".join(w[:-8]), " ".join(w), " ".join(f"v{i}" for i in range(400))]
    a, b = (minhash.signature(minhash.Shingler()(t)) for t in texts[:2])
    assert abs(minhash.likeness(a, b) - 388 / 396) < 0.05
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.rep_a, r.rep_b) for r in minhash.near_duplicates(d).collect()] == [(0, 1)]


@pytest.mark.parametrize("most", [4096, 3])
def test_near_classes_lose_no_link(spark, most):
    rnd = random.Random(11)
    base = [" ".join(rnd.choices("abcdefghij", k=4)) + f" {i}" for i in range(60)]
    made = []
    for i in range(40):
        words = " ".join(base).split() if i < 30 else rnd.choices("klmnop", k=80)
        for _ in range(i % 7):
            words[rnd.randrange(len(words))] = rnd.choice("qrstuv")
        made.append((i, " ".join(words)))
    made += [(40, None), (41, ""), (42, made[0][1]), (None, made[35][1])]
    sets = [set(minhash.Shingler()(t or "").tolist()) for _, t in made]
    label = np.arange(len(made))
    for x in range(len(made)):
        for y in range(x):
            total = len(sets[x] | sets[y])
            if (len(sets[x] & sets[y]) / total if total else 1.0) >= 0.8:
                simhash.merge_labels(label, np.array([x]), np.array([y]))
    low = {c: min(made[k][0] for k in range(len(made)) if label[k] == c and made[k][0] is not None) for c in set(label.tolist())}
    d = spark.createDataFrame(made, "doc_id long, text string")
    got = minhash.near_classes(d, most=most).collect()
    _same([(r.doc_id, r.class_id) for r in got], [(i, low[int(label[k])]) for k, (i, _) in enumerate(made)])
    links = [(r.rep_a, r.rep_b) for r in minhash.near_duplicates(d, most=most).collect()]
    ends = {i: sets[k] for k, (i, _) in enumerate(made) if i is not None}
    assert links and all(len(ends[a] & ends[b]) >= 0.8 * len(ends[a] | ends[b]) for a, b in links)


def test_near_classes_deal_large_classes_to_more_shards(spark, tmp_path, monkeypatch):
    """A class that is dealt to many slices sends its sets many times; what a worker gets at a time stays bounded all the same."""
    words = [f"w{k}" for k in range(60)]
    made = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(60)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    want = sorted((r.doc_id, r.class_id) for r in minhash.near_classes(d).collect())
    linked = minhash._linked

    def spied(similar, verify):
        run = linked(similar, verify)

        def one(pdf):
            if verify:
                (tmp_path / f"{pdf.shard.iloc[0]}").write_text(str(sum(map(len, pdf.shingles))))
            return run(pdf)

        return one

    monkeypatch.setattr(minhash, "_linked", spied)
    monkeypatch.setattr(minhash, "MOST_SHINGLES", 200)
    assert sorted((r.doc_id, r.class_id) for r in minhash.near_classes(d).collect()) == want
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(sizes) > 20 and max(sizes) < 10 * 200


def test_near_classes_read_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """Texts of one large partition come a few at a time."""
    d = spark.range(2000).coalesce(1).selectExpr("id AS doc_id", "repeat(concat('a', id, ' '), 1500) AS text")
    kept = minhash.mapped

    def spied(d, run, schema):
        def one(batches):
            def told(b):
                (tmp_path / f"{b.doc_id.iloc[0]}").write_text(str(len(b)))
                return b

            return run(map(told, batches))

        return kept(d, one, schema)

    monkeypatch.setattr(minhash, "mapped", spied)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    rows, _ = minhash._distinct_sets(d)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "64m"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) == rows.count() == 2000 and max(sizes) < 1500


def test_simhash(docs, rows):
    fps = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    label = np.arange(len(rows))
    for k in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3)
        simhash.merge_labels(label, np.full(len(near), k), near)
    low = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label.tolist())}
    want = [(i, f"{int(fps[k]):016x}", low[int(label[k])]) for k, (i, _) in enumerate(rows)]
    _same([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_classes(docs).collect()], want)


def test_dedup_with_null_and_repeated_ids(spark):
    rnd = random.Random(8)
    one, two, three, four = (" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(900)}" for _ in range(120)) for _ in range(4))
    made = [(None, one), (1, two), (None, two), (2, three), (2, four), (2, four), (3, three), (None, None), (None, "")]
    d = spark.createDataFrame(made, "doc_id long, text string")
    got = simhash.dedup(d).collect()
    _same([(r.doc_id, r.text or "") for r in got], [(None, one), (1, two), (2, three), (2, four), (None, "")])


@pytest.mark.parametrize("most", [8192, 10])
def test_trees_find_all_links(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    v = np.unique(base[rng.integers(0, 5, 400)] ^ bit() ^ bit())
    label = np.arange(len(v))
    for k in range(len(v)):
        near = np.flatnonzero(np.bitwise_count(v ^ v[k]) <= 3)
        simhash.merge_labels(label, np.full(len(near), k), near)
    fps = spark.createDataFrame([(int(x),) for x in v.astype(np.int64)], "fp long")
    got = {r.node: r.root for r in components.components(simhash.link_fingerprints(fps, most=most)).collect()}
    groups = collections.defaultdict(set)
    for x, c in zip(v.astype(np.int64).tolist(), label.tolist()):
        groups[c].add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set.union(*groups.values()))


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_suffix_tree(docs, rows):
    train = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for _, t in train for w in [*words_of(t), None])
    n, v = sum(c.values()), len(c)
    got = sorted(suffix_tree.score_documents(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(rows, key=lambda r: (str(r[0]), len(words_of(r[1]))))
    for r, (i, t) in zip(got, want, strict=True):
        w = [*words_of(t), None]
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(w), sum(c[x] > 0 for x in w), n)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_suffix_tree_in_parts_is_the_whole_tree(spark, monkeypatch):
    """Several blocks, scores equal to those of the tree held whole, and no least share of the corpus."""
    monkeypatch.setattr(suffix_tree, "P_MIN", 0.01, raising=False)
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 200_000)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    ids, sizes, hashes = suffix_tree.symbols([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    keys, back = np.unique(hashes, return_inverse=True)
    counts = np.bincount(back[ids], minlength=len(keys))
    often = counts >= suffix_tree.LEAST_COUNT
    tree = suffix_tree.Tree(keys[often], counts[often], len(ids), len(keys))
    for _ in range(suffix_tree.DEPTH):
        k, c = np.unique(tree.candidate_keys(ids, sizes, hashes), return_counts=True)
        tree.add_level(k[c >= suffix_tree.LEAST_COUNT], c[c >= suffix_tree.LEAST_COUNT])
    tree.settle()
    known = dict(zip(keys.tolist(), counts.tolist()))
    contexts = sum(int((~np.isnan(b)).sum()) for b in tree.back)
    assert all((~np.isnan(b)).any() for b in tree.back)
    for r in suffix_tree.score_documents(d).collect():
        one, size, h = suffix_tree.symbols([texts[r.doc_id]])
        _, p = tree.log10(one, size, h, np.array([known.get(x, 0) for x in h.tolist()])[one])
        assert r.n_contexts == contexts and math.isclose(r.score, p.sum(), rel_tol=1e-9)


def test_suffix_states_are_distributions():
    """With all words frequent, each state's probabilities, unknown word included, sum to one."""
    rng = np.random.default_rng(5)
    ids = np.array([1 + (k % 3 if rng.random() < 0.9 else rng.integers(0, 3)) for k in range(3000)])
    tree = suffix_tree.Tree(np.array([1, 2, 3], np.uint64), np.bincount(ids)[1:], 3000, 3)
    sizes, hashes = np.array([3000]), np.arange(4, dtype=np.uint64)
    for _ in range(2):
        tree.add_level(*np.unique(tree.candidate_keys(ids, sizes, hashes), return_counts=True))
    tree.settle()
    assert any((~np.isnan(b)).any() for b in tree.back)
    counts = np.array([0, *tree.counts[0]])
    for context in ([1], [2, 3], [3, 1]):
        p = [10 ** tree.log10(np.array([*context, x]), np.array([len(context) + 1]), hashes, counts[[*context, x]])[1][-1] for x in (1, 2, 3)]
        unknown = 10 ** tree.log10(np.array([*context, 0]), np.array([len(context) + 1]), np.array([9, 1, 2, 3], np.uint64), np.array([*counts[context], 0]))[1][-1]
        assert math.isclose(sum(p) + unknown, 1.0, rel_tol=0.02)


def _repeats(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking at every window."""
    texts = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, rows):
    _same([tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()], _repeats(rows))


def test_cut_repeats_gives_bytes_and_spans(docs, rows):
    """Spans lie apart and in order, and what they leave is `kept`; its digests are those of a look at every window."""
    got = suffix_dedup.cut_repeats(docs).collect()
    of = collections.defaultdict(set)
    for i, t in rows:
        of[i].add(t.encode("utf-8", "surrogatepass"))
    for r in got:
        edges = [x for s in r.spans for x in (s.start, s.end)]
        assert edges == sorted(set(edges))
        assert bytes(r.kept) in {b"".join(b[a:z] for a, z in zip([0, *edges[1::2]], [*edges[::2], len(b)])) for b in of[r.doc_id]}
    _same([(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got], _repeats(rows))


def test_anchor_runs_do_not_depend_on_stretches():
    b = np.frombuffer(bytes(random.Random(5).choice(b"abc") for _ in range(3000)) + b"a" * 900, np.uint8)

    def per_window(stretch):
        h, first, last = suffix_dedup.anchor_runs(b, 100, stretch)
        return np.repeat(h, last - first + 1).tolist(), np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last)]).tolist()

    want = per_window(1 << 20)
    assert want[1] == list(range(len(b) - 99))
    assert all(per_window(s) == want for s in (1, 7, 100, 2000))
    assert len(suffix_dedup.anchor_runs(b[:99], 100)[0]) == 0


def test_merged_transforms_agree_with_strides():
    rnd = random.Random(3)
    for _ in range(20):
        base = [bytes(rnd.choice(b"ab") for _ in range(60)) for _ in range(3)]
        ps = list({b[rnd.randint(0, 10) :] + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 20))) for b in base * 6})
        shards = [x for x in (ps[: len(ps) // 2], ps[len(ps) // 2 :]) if x]
        made = [suffix_dedup.transform(x) for x in shards]
        shard, common = suffix_dedup.merge_transforms([m[1] for m in made], 12)
        together = common >= 12
        repeated = together | np.concatenate([together[1:], [False]])
        flags = []
        for k, x in enumerate(shards):
            f = np.zeros(len(made[k][0]), bool)
            f[made[k][0]] = repeated[shard == k]
            at = 0
            for p in x:
                flags.append(f[at : at + len(p) - 11])
                at += len(p) + 1
        assert all((a == b).all() for a, b in zip(flags, suffix_dedup.repeated_windows(ps, 12)))


def test_urls(spark):
    rnd = random.Random(1)
    for _ in range(60):
        globs = ["".join(rnd.choice("ab*?/") for _ in range(rnd.randint(0, 7))) for _ in range(rnd.randint(1, 30))]
        texts = ["".join(rnd.choice("ab/é") for _ in range(rnd.randint(0, 9))) for _ in range(20)]
        hit = urls.ShiftAnd(globs).match(texts)
        assert all(hit[i, k] == fnmatch.fnmatchcase(s, g) for i, s in enumerate(texts) for k, g in enumerate(globs))
    cases = [
        (1, "https://Example.com/en/71?x", "example.com/en/7", "allow"), (2, "http://a.b.com/en/x", "com/en/", "block"), (3, None, None, "allow"), (4, "no scheme", None, "allow"),
        (5, "http://example.net/de/81", "example.net/de/8", "block"), (6, "http://xcom/en/", None, "allow"), (7, "http://ads.site.info/x", None, "block"), (8, "http://org/es/#f", "org/es/", "block"),
        (8, "http://org/es/#f", "org/es/", "block"), (9, "http://h.net?/de/", None, "allow"),
    ]
    d = spark.createDataFrame([(i, u, 1) for i, u, _, _ in cases], "page_id long, url string, host int")
    _same([(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(d).collect()], [(i, r, v) for i, _, r, v in cases])
    assert urls.judge_urls(d.where("page_id < 0")).collect() == []


def test_bpe(docs, rows):
    import tiktoken

    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    _same([tuple(r) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()], want)


def test_bpe_random_and_long_pieces():
    import tiktoken

    t = bpe.Transducer(bpe.load_ranks(PATH), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    rnd = random.Random(2)
    for s in ["a" * 20000, " " * 9999 + "x", "ab" * 6000, "漢字😀é" * 500, "=-" * 3000] + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0xA0, 0x2FF), 0x1F600, 10])) for _ in range(80)) for _ in range(200)]:
        ids = t.encode(s)
        assert ids == library.encode_ordinary(s) and t.decode(ids) == s


def test_utf8_stream():
    rnd = random.Random(4)
    for _ in range(300):
        data = bytes(rnd.choice([0x41, 0x80, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0xFF]) for _ in range(rnd.randint(0, 12)))
        s, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = rnd.randint(1, 4)
            out += s.feed(data[at : at + step])
            at += step
        assert out + s.end() == data.decode("utf-8", "replace")


def test_decontamination(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(5000, None), (5001, ""), (5002, "tiny item")], "item_id long, text string"))
    texts = {r.item_id: r.text for r in items.collect()}
    planted = [(800001, "Before it. " + texts[3] + " After it."), (800002, "x " * 500 + texts[7].upper()), (800003, " ".join(texts[3].split()[:8])), (800004, None), (800005, "here is a tiny item in words")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    want = set()
    parts = {i: decontaminate.shingles(decontaminate.WORDS((t or "").lower())) for i, t in texts.items()}
    for r in d.collect():
        w = decontaminate.WORDS((r.text or "").lower())
        for i, p in parts.items():
            k = len(next(iter(p))) if p else 1
            if p and len(p & set(zip(*(w[j:] for j in range(k))))) >= 0.8 * len(p):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.retrieve(d, items).where("overlap >= 0.8").collect()}
    assert got == want and (800001, 3) in got and (800002, 7) in got and (800005, 5002) in got
    clean = decontaminate.keep_clean(d, items)
    hit = {i for i, _ in got}
    assert clean.columns == d.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in d.collect() if r.doc_id not in hit)
    assert decontaminate.keep_clean(docs, items).columns == docs.columns


@pytest.mark.parametrize("answer", ["Lisbon.", "In Lisbon.", "In old Lisbon.", "Near the old harbour."])
def test_short_answers_split_and_reordered(answer):
    question = "Which town did the painter leave for the last time in spring?"
    index = decontaminate.Index([(1, f"{question} {answer}"), *((k, f"{k} other words stand in item {k}. None.") for k in range(2, 9))])
    for text in (f"{question} Nobody knew it. {answer}", f"{answer} {question}"):
        (hit,) = [h for h in index.hits(text, 0.6) if h[0] == 1]
        assert hit[3] == 1.0 and hit[4] == 1.0
    assert [h[0] for h in decontaminate._verified(index, f"{answer} {question}", 0.6, 0.95)] == [1]
    assert not decontaminate._verified(index, f"{question} Porto.", 0.6, 0.95)


def test_wand_finds_all():
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice("abcdefghijklmnop") * 2 for _ in range(rnd.randint(3, 12)))) for i in range(120)]
    index = decontaminate.Index(items)
    for _ in range(60):
        terms = sorted({rnd.randrange(len(index.term)) for _ in range(rnd.randint(1, 12))})
        full = collections.Counter()
        for t in terms:
            for i, x in zip(index.docs[t], index.impacts[t]):
                full[i] += x
        assert sorted(i for i, _ in index.search(terms, 0.6)) == sorted(i for i, x in full.items() if x >= 0.6 - 1e-9)


def test_toxicity(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = toxicity.judge(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in judged) >= 0.9 * len(judged)
    assert toxicity.keep_clean(d, labels).columns == d.columns
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert all(r.score is not None and r.held_out is not None for r in toxicity.judge(odd, labels.where("doc_id < 0")).collect())


def test_training_texts_are_used_whole(spark):
    long = " ".join("".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=5), 21_000))
    d = spark.createDataFrame([(i, long + (" zebra" if i % 2 else "")) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert toxicity.fit(d, labels).weights.get("zebra", 0) > 0


def test_counterfactuals_calm_identity_terms():
    rows = [(["women", "idiot", "are", f"w{i % 9}"], 1) for i in range(60)] + [(["men", "are", "fine", f"w{i % 9}"], 0) for i in range(60)] + [(["idiot", "you"], 1)] * 20 + [(["women", "fine"], 0)] * 4
    gap = lambda m: abs(m.weights.get("women", 0) - m.weights.get("men", 0))
    assert gap(toxicity.train(rows, penalty=4.0)) < 0.5 * gap(toxicity.train(rows, penalty=0.0))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert {i: r.decoded_sha256 for i, r in out.items()} == want


def test_long_items_and_ids_of_any_type(spark):
    """An item of over 512 words: its question and answer are looked up in the whole text, in any order; null and text ids sort."""
    rnd = random.Random(21)
    words = [f"w{rnd.randrange(5000)}" for _ in range(1300)]
    question, answer = " ".join(words[:1280]) + ".", " ".join(words[1280:]) + "."
    items = spark.createDataFrame([("long", question + " " + answer), (None, "some other words that nobody has ever said before"), ("short", "what is the name of the tall tower? the tower of stone")], "item_id string, text string")
    filler = " ".join(f"f{rnd.randrange(5000)}" for _ in range(300))
    docs = spark.createDataFrame([("a", f"{filler} {answer} {filler} {question} {filler}"), ("b", filler), ("c", "x what is the name of the tall tower? the tower of stone x"), (None, "some other words that nobody has ever said before")], "doc_id string, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.retrieve(docs, items).collect()}
    assert got.keys() == {("a", "long"), ("c", "short"), (None, None)}
    assert got[("a", "long")].question_overlap > 0.99 and got[("a", "long")].answer_overlap > 0.99
    assert [r.doc_id for r in decontaminate.keep_clean(docs, items).collect()] == ["b"]


def test_next_document_over_ids_of_any_type(spark):
    rnd = random.Random(4)
    made = [(rnd.choice([None, *(f"id{i % 40:03d}" for i in range(60))]), f"text {i}") for i in range(200)]
    d = spark.createDataFrame(made, "doc_id string, text string")
    some = [m for m in made if m[0] is not None]
    order = sorted(sorted(some, key=lambda m: m[1]), key=lambda m: m[0], reverse=True) + sorted(m for m in made if m[0] is None)
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    _same([(r.doc_id, r.text, r.next_text) for r in minhash.with_next(d, 300).collect()], want)
    _same([(r.doc_id, r.text, r.next_text) for r in minhash.with_next(d.where("doc_id IS NULL"), 300).collect()], [(None, t, sorted(m[1] for m in made if m[0] is None)[(k + 1) % (200 - len(some))]) for k, t in enumerate(sorted(m[1] for m in made if m[0] is None))])


def test_swapping_a_group_hardly_moves_the_score():
    """Toxic sentences name one group of each pair more often; the score of a neutral one must not."""
    rnd = random.Random(3)
    pairs = {"women": "men", "muslims": "christians", "gay": "straight", "immigrants": "natives"}
    rows = []
    for i in range(400):
        g = rnd.choice(list(pairs))
        nice, bad = rnd.sample(["garden", "music", "school", "kitchen", "river", "holiday"], 3), rnd.sample(["stupid", "awful", "vermin", "trash"], 2)
        rows.append(([g, "are", "here", *bad, nice[0]], 1) if i % 2 else ([pairs[g] if rnd.random() < 0.8 else g, "are", "here", *nice], 0))
    free, held = toxicity.train(rows, penalty=0.0), toxicity.train(rows)
    for a, b in pairs.items():
        gap = [abs(m.score(f"{a} are here") - m.score(f"{b} are here")) for m in (free, held)]
        assert gap[0] > 0.3 and gap[1] < 0.05
        assert held.score(f"{a} are vermin trash") > 0.9 > 0.3 > held.score(f"{a} like music garden river")


def test_toxicity_scores_by_hand(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    full = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(full, labels)
    want = {}
    for r in full.select("doc_id", "text").collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        z = model.bias + math.fsum(v for f, v in model.weights.items() if f in words or (f.endswith("*") and any(len(w) > 4 and w[:4] == f[:-1] for w in words)))
        want[r.doc_id] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    for r in toxicity.judge(full, labels).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-6, abs_tol=1e-12) and r.predicted == (r.score >= 0.3)


def test_span_model_tells_planted_data_from_decoys(spark):
    """Spans that the base patterns leave out are added where form, lists and context speak for them; decoys stay out."""
    rnd = random.Random(5)
    hexes = lambda n: "".join(rnd.choices("0123456789abcdef", k=n))
    iban = "DE89370400440532013000"
    real = ["call (212) 555-0142 now", f"token = '{hexes(40)}'", f"our account is {iban}", "mail jane.doe (at) example.com", "my ssn 512-34-8765", f"api_key={hexes(32)}"]
    decoy = ["order 1234567890123456 shipped", "see commit release-candidate-number-twelve-7", "code DE00370400440532013000 x", "ip 999.1.2.3 x", f"build {'x1' * 4} y", "the 123-456-78901 thing"]
    base = ["a@b.com", "10.1.2.3", "4111 1111 1111 1111", "+1 212 555 0142"]
    made = [(i, f"filler words {rnd.choice(real + decoy + base)} and more {rnd.choice(base)} end") for i in range(600)]
    n_real = sum(any(x in t for x in real) for _, t in made)
    d = spark.createDataFrame(made, "doc_id long, text string")
    added = caught = wrong = 0
    for r, (_, t) in zip(sorted(pii.find_pii(d).collect()), made):
        more = [x for x in r.spans.split(",") if x and x not in {f"{n}:{s}:{e}" for s, _, e, n in _base_spans(t)}]
        added += len(more)
        caught += bool(more) and any(x in t for x in real)
        wrong += sum(not any(x in t for x in real) for _ in more)
    assert caught >= 0.9 * n_real and wrong <= 0.1 * added


def test_many_matches_in_one_text_take_little_time(spark):
    import time

    mails = " ".join(f"a{i}@b.com" for i in range(20000))
    d = spark.createDataFrame([(1, mails)], "doc_id long, text string")
    pii.find_pii(d.limit(0)).collect()
    began = time.time()
    r = pii.find_pii(d).first()
    assert r.n_email == 20000 and time.time() - began < 10
    at, spans = 0, []
    for m in mails.split(" "):
        spans.append(f"email:{at}:{at + len(m)}")
        at += len(m) + 1
    assert r.spans == ",".join(spans)
    began = time.time()
    assert pii.redact(d).first().text == " ".join(["[EMAIL]"] * 20000) and time.time() - began < 10
    began = time.time()
    many = spark.createDataFrame([(1, "MIT License, " * 20000)], "doc_id long, text string")
    assert licenses.scan_licenses(many).first().n_base == 20000 and time.time() - began < 10


def _sample(rx, pick):
    """A text that a signature matches: branch `pick` of each choice, fewest repeats."""
    import re._parser as parser

    def made(tree):
        out = ""
        for op, value in tree:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "MAX_REPEAT":
                out += made(value[2]) * value[0]
            elif kind == "SUBPATTERN":
                out += made(value[-1])
            elif kind == "BRANCH":
                out += made(value[1][min(pick, len(value[1]) - 1)])
            elif kind == "IN":
                first, v = value[0]
                out += chr(v if str(first) == "LITERAL" else v[0]) if str(first) in ("LITERAL", "RANGE") else "a"
            elif kind == "ANY":
                out += "x"
        return out

    return made(parser.parse(rx))


def test_every_signature_passes_its_gate_and_is_found(spark):
    """Each hand-written signature alone, branch by branch and with other separators, gives its label."""
    cases = {_sample(rx, pick) for _, _, rx, _, _ in licenses.SENTENCES for pick in range(3)}
    cases = sorted(cases | {c.replace(" ", "\n  ") for c in cases})
    want = {c: {label for label, _, rx, _, _ in licenses.SENTENCES if re.search(licenses._spaced(rx), c)} for c in cases}
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(d).collect()}
    # a detection inside a longer one is suppressed, so a case gives one of its own labels at least
    assert [c for i, c in enumerate(cases) if want[c] and not got[i] & want[c]] == []
    assert all(want[c] for c in cases if "\n" not in c)


@pytest.mark.parametrize("most", [1000, 1])
def test_hot_anchors_are_split_exactly(spark, monkeypatch, most):
    """One passage among many surroundings, whole, cut and shifted, so that an anchor has many different pieces."""
    monkeypatch.setattr(suffix_dedup, "MOST_PLACES", most)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 30_000)
    rnd = random.Random(most)
    word = lambda: "".join(rnd.choices("abcde", k=rnd.randrange(2, 9)))
    passage = " ".join(word() for _ in range(200))
    made = []
    for i in range(120):
        low = rnd.randrange(0, 500)
        cut = passage[low : low + rnd.choice([150, 300, 399, 400, 420, 700])]
        made.append((i, " ".join(word() for _ in range(rnd.randrange(0, 150))) + cut + " ".join(word() for _ in range(rnd.randrange(0, 150)))))
    made += [(200 + i, passage) for i in range(5)]
    want = _repeats(made)
    d = spark.createDataFrame(made, "doc_id long, text string")
    _same([tuple(r) for r in suffix_dedup.remove_repeats(d).collect()], want)
