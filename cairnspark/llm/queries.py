"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from cairnspark.llm import bpe, decontaminate, licenses, minhash, pii, simhash, suffix_dedup, suffix_tree, toxicity, urls
from cairnspark.llm.common import read


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def queries() -> dict:
    return {
        "op1_suffix_tree": lambda s, d: suffix_tree.score_documents(read(s, d, "documents")),
        "op2_pii": lambda s, d: pii.find_pii(read(s, d, "documents")),
        "op3_minhash": lambda s, d: minhash.fingerprint_edits(read(s, d, "documents")),
        "minhash_near_classes": lambda s, d: minhash.near_classes(read(s, d, "documents")),
        "op4_decontamination": lambda s, d: decontaminate.retrieve(read(s, d, "documents"), read(s, d, "benchmark")),
        "op5_simhash": lambda s, d: simhash.near_classes(read(s, d, "documents")),
        "op6_toxicity": lambda s, d: toxicity.judge(read(s, d, "documents"), read(s, d, "labels")),
        "op7_suffix_dedup": lambda s, d: suffix_dedup.remove_repeats(read(s, d, "documents")),
        "op8_url_filter": lambda s, d: urls.judge_urls(read(s, d, "pages")),
        "op9_bpe": lambda s, d: bpe.round_trip(read(s, d, "documents"), *_tokenizer()),
        "op10_licenses": lambda s, d: licenses.scan_licenses(read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
