"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from lodestore.llm import bpe, covertree, lm, middle, minhash, nearest, packing, quality, rules, shards, substring, toxicity, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_covertree": covertree.op1_covertree,
    "op2_warc": warc.op2_warc,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality": quality.op4_quality,
    "op5_lm": lm.op5_lm,
    "op6_rules": rules.op6_rules,
    "op7_packing": packing.op7_packing,
    "op8_minhash": minhash.op8_minhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_substring": substring.op10_substring,
    "op11_words": shards.op11_words,
    "op12_nearest": nearest.op12_nearest,
    "op13_middle": middle.op13_middle,
}
ORACLE = {
    "op1_covertree": covertree.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op6_rules": rules.OP6_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op10_substring": substring.OP10_SQL,
    "op12_nearest": nearest.OP12_SQL,
    "op13_middle": middle.OP13_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
