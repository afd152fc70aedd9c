"""The registered queries of this subpackage, and the pipeline over them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name: module that holds it and, where SQL can say it, its SQL as SQL
QUERIES = {
    "op1_language_id": "langid",
    "op2_byte_bpe": "bpe",
    "op3_quality_classifier": "quality",
    "op4_substring_dedup": "substring",
    "op5_minhash_near_dedup": "neardup",
    "op6_personal_data": "pii",
    "op7_training_order": "ordering",
    "op8_sharding": "sharding",
    "op9_decontamination": "contamination",
    "op10_quality_rules": "lines",
    "op11_filter_interaction": "interaction",
    "op12_source_divergence": "divergence",
    "op13_simhash_near_dedup": "simhash",
}


def _run(module: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"riskpanel.llm.{module}"), name)(spark, sf_dir)
    return run


def queries() -> dict:
    found = {name: _run(module, name) for name, module in QUERIES.items()}
    found["pipeline"] = import_module("corpus_pipeline").run
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"riskpanel.llm.{module}"), "SQL", None) for name, module in QUERIES.items()}
    found["pipeline"] = import_module("corpus_pipeline").ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}
