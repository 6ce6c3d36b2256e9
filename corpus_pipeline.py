"""Five cleaning stages over `documents`; each keeps documents of their own columns, the last encodes what is left.

Defined results, for every stage: null texts read as empty ones; null and repeated doc_ids are rows like any other; extra columns
stay as they are, whatever their names; no rows give no rows; without labels or items nothing is rejected on their account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import bpe, decontaminate, pii, simhash, toxicity
from cairnspark.llm.common import forget, read, stored
from cairnspark.llm.queries import _tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a classifier fitted on their labels."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the least doc_id, of equal ones the least hash of the text; empty texts are one group."""
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote no benchmark item."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; null texts become empty, n_chars follows."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and digests; an empty text has no tokens."""
    return bpe.round_trip(docs, *_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode),
]
#: Not expressible in SQL; the tests hold each stage against a plain version of what it decides.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
