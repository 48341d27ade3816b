"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import conversations, decontaminate, fill_middle, minhash, mixing, private_data, quality, secrets, simhash, suffix_arrays, suffix_trees, token_files, toxicity
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": _documents(simhash.op1_query),
    "op2_suffix_tree_dedup": _documents(suffix_trees.remove_repeats),
    "op3_minhash_fingerprints": _documents(minhash.op3_query),
    "op4_mix_sources": _documents(mixing.op4_query),
    "op5_private_data": _documents(private_data.find_private),
    "op6_quality_classifier": lambda spark, sf_dir: quality.op6_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_secret_scan": _documents(secrets.scan_secrets),
    "op8_suffix_array_dedup": _documents(lambda docs: suffix_arrays.op8_query(docs, suffix_arrays.PASSAGE)),
    "op9_benchmark_decontamination": lambda spark, sf_dir: decontaminate.op9_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op10_token_files": _documents(token_files.op10_query),
    "op11_fill_middle": _documents(fill_middle.op11_query),
    "op12_toxic_spans": lambda spark, sf_dir: toxicity.op12_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_conversation_repair": lambda spark, sf_dir: conversations.op13_query(table(spark, sf_dir, "conversations")),
}

ORACLES: dict[str, str] = {
    "op2_suffix_tree_dedup": suffix_trees.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
