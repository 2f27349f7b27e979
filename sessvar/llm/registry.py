"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: module and query of each operator
QUERIES = {
    "op1_context_mixing": "scoring",
    "op2_mixture": "mixing",
    "op3_best_fit_packing": "packing",
    "op4_pseudonyms": "pii",
    "op5_shard_table": "sharding",
    "op6_quality_rules": "rules",
    "op7_simhash_components": "simhash",
    "op8_line_dedup": "lines",
    "op9_quality": "quality",
    "op10_media_columns": "media",
    "op11_embedding_whitening": "whitening",
    "op12_merkle_manifest": "manifest",
    "op13_ngram_jaccard": "jaccard",
}


def queries() -> dict[str, Query]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import lines, manifest

    return {"op8_line_dedup": lines.SQL, "op12_merkle_manifest": manifest.SQL}
