"""Toxicity: a logistic word classifier regularised by counterfactuals.

It is fitted on a bounded sample of the labelled training documents (`MOST_LABELLED`, those of smallest hash). Where a
text names a group, its identity terms are swapped for others, the swapped text's features are made anew, and the squared
change of the score is penalised, so the group named moves the score as little as possible. A text's features are the
distinct words it holds (letters only, lower case) and the four-letter beginnings of longer ones; the vocabulary is made of
features in at least `LEAST_TEXTS` sampled texts whose share of label 1 stands out by `LEAST_Z` standard errors, at most
`MOST_WORDS`, and of the identity terms with their beginnings: the model sent to the tasks is bounded. Scoring is row by
row: no shuffle, no skew.

Defined results: null and empty texts are scored by the bias; without labels, or with one class only, every text gets
the smoothed share of label 1; repeated labels of a document count once (the larger); repeated documents repeat, and of
different texts of one labelled id the one whose word list sorts first is learned from; extra columns are ignored
(keep_clean keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import held_out, mapped, texts

MOST_LABELLED, MOST_WORDS, LEAST_TEXTS = 6_000, 10_000, 5
PENALTY, RIDGE, STEPS, THRESHOLD, LEAST_Z = 4.0, 3e-5, 150, 0.3, 4.0
WORDS = re.compile(r"[^\W\d_]+").findall
#: Groups of identity terms that may stand for each other.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("females", "males"), ("she", "he"), ("mother", "father"), ("wives", "husbands"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic", "protestant"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics", "protestants"),
    ("islam", "christianity", "judaism", "hinduism", "buddhism", "atheism"), ("black", "white", "asian", "latino", "arab", "hispanic"), ("blacks", "whites", "asians", "latinos", "arabs", "hispanics"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"), ("gays", "straights", "lesbians", "bisexuals"), ("immigrants", "natives", "refugees", "migrants"), ("immigrant", "native", "refugee", "migrant"),
    ("african", "european", "american", "mexican", "chinese", "indian", "turkish", "polish", "russian"), ("africans", "europeans", "americans", "mexicans", "indians", "turks", "poles", "russians"),
    ("old", "young"), ("elderly", "teenage"), ("disabled", "able"), ("deaf", "hearing"), ("blind", "sighted"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("juifs", "chrétiens", "musulmans", "catholiques", "athées"), ("juif", "chrétien", "musulman", "catholique", "athée"),
    ("noirs", "blancs", "arabes", "asiatiques"), ("homosexuels", "hétérosexuels"), ("immigrés", "réfugiés"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("juden", "christen", "muslime", "katholiken", "atheisten"), ("jüdisch", "christlich", "muslimisch", "katholisch"),
    ("schwarze", "weiße", "asiaten", "araber"), ("schwule", "heteros", "lesben"), ("ausländer", "einwanderer", "flüchtlinge"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("judíos", "cristianos", "musulmanes", "católicos", "ateos"), ("judío", "cristiano", "musulmán", "católico", "ateo"),
    ("negros", "blancos", "árabes", "asiáticos"), ("homosexuales", "heterosexuales"), ("inmigrantes", "refugiados"),
)
SWAP = {w: group[(i + 1) % len(group)] for group in IDENTITY for i, w in enumerate(group)}


def words_in(text: str) -> set[str]:
    return set(WORDS(text.lower()))


def features(words: set[str]) -> set[str]:
    return words | {w[:4] + "*" for w in words if len(w) > 4}


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def score(self, text: str) -> float:
        w = self.weights
        z = self.bias + sum(w[x] for x in w.keys() & features(words_in(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: Iterable[tuple[Iterable[str], int]], penalty: float = PENALTY) -> Model:
    """rows: words and label. Full-batch Adam on log loss + ridge + penalty * mean squared counterfactual change.

    The change is that of the score before the logistic function, over the texts that name a group. Texts are held as numbers of their words.
    """
    number: dict[str, int] = {}
    texts_, labels = [], []
    for words, y in rows:
        texts_.append(np.unique(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32)))
        labels.append(y)
    n, ones = len(labels), sum(labels)
    if not 0 < ones < n:
        p = (ones + 0.5) / (n + 1)
        return Model(float(np.log(p / (1 - p))), {})
    for w in SWAP:
        number.setdefault(w, len(number))
    whole = list(number)  # words, then their beginnings
    start = np.array([number.setdefault(w[:4] + "*", len(number)) if len(w) > 4 else -1 for w in whole], np.int32)
    names, instead = list(number), np.arange(len(number), dtype=np.int32)
    for w, other in SWAP.items():
        instead[number[w]] = number[other]

    def featured(words: np.ndarray) -> np.ndarray:
        more = start[words]
        return np.unique(np.concatenate([words, more[more >= 0]]))

    sets = [featured(w) for w in texts_]
    y = np.array(labels, float)
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets) if n else np.zeros(0, int)
    seen, with_one = np.bincount(every, minlength=len(names)), np.bincount(every, np.repeat(y, size), len(names))
    share = ones / n
    gap = np.where(seen >= LEAST_TEXTS, np.abs(with_one - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share)), 0.0)
    best = sorted(np.flatnonzero(gap >= LEAST_Z).tolist(), key=lambda i: (-gap[i], names[i]))[:MOST_WORDS]
    vocabulary = sorted(names[i] for i in best)
    vocabulary += sorted(features(set(SWAP)) - set(vocabulary))
    at = np.full(len(names), -1, np.int64)
    at[[number[w] for w in vocabulary]] = np.arange(len(vocabulary))

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x[x >= 0] for x in (at[s] for s in sets)]
        return np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids) if ids else np.zeros(0, int)

    row, col = matrix(sets)
    swapped = [(made, featured(np.unique(instead[w]))) for made, w in zip(sets, texts_) if (instead[w] != w).any()]
    r1, c1 = matrix([np.setdiff1d(a, b) for a, b in swapped])
    r2, c2 = matrix([np.setdiff1d(b, a) for a, b in swapped])
    m = len(swapped)
    w, b = np.zeros(len(vocabulary)), float(np.log(ones / (n - ones)))
    mom, var, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, w[col], n)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(col, err[row], len(w)) + RIDGE * w
        if m:
            change = (np.bincount(r1, w[c1], m) - np.bincount(r2, w[c2], m)) * (2 * penalty / m)
            g += np.bincount(c1, change[r1], len(w)) - np.bincount(c2, change[r2], len(w))
        gb = err.sum()
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 if step < STEPS * 2 // 3 else 0.03
        w -= rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model(b, {x: float(v) for x, v in zip(vocabulary, w) if abs(v) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Trained on at most `most` labelled documents that are not held out (crc32 of the id, mod 4, is 2)."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id", 4))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    d = texts(docs).join(F.broadcast(marked), "doc_id")  # at most `most` ids

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "toxic": b.toxic, "words": [" ".join(sorted(words_in(t))) for t in b.text]})

    got = mapped(d.select("doc_id", "toxic", "text"), words, "toxic int, words string")
    got = got.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words"))
    rows = sorted((r.doc_id, r.words, r.toxic) for r in got.collect())
    return train((w.split(), y) for _, w, y in rows)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    d = texts(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "score": np.array([model.score(t) for t in b.text], float)})

    return mapped(d, run, "score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", F.coalesce(held_out("doc_id", 4), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored below the threshold, with their columns: judged row by row, so nothing is joined or shuffled."""
    model = fit(docs, labels)
    kind = docs.schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            place = b.schema.get_field_index("text")
            yield b.filter(pa.array([model.score(t or "") < THRESHOLD for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, kind)
