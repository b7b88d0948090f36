"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fathomline.llm.conversation_repair import op13
from fathomline.llm.crf_quality import op1
from fathomline.llm.fill_middle import OP11_SQL, op11
from fathomline.llm.line_dedup import OP6_SQL, op6
from fathomline.llm.mixing import OP7_SQL, op7
from fathomline.llm.multiset_hash import op2
from fathomline.llm.packing import op3
from fathomline.llm.quality_rules import op8
from fathomline.llm.resharding import op4
from fathomline.llm.simhash import op9
from fathomline.llm.substring_dedup import op10
from fathomline.llm.token_counts import op12
from fathomline.llm.toxicity_chain import op5

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_crf_quality": op1,
    "op2_multiset_hash": op2,
    "op3_best_fit_packing": op3,
    "op4_flow_resharding": op4,
    "op5_toxicity_chain": op5,
    "op6_site_line_dedup": op6,
    "op7_poisson_mixing": op7,
    "op8_line_first_rules": op8,
    "op9_simhash_tiles": op9,
    "op10_suffix_array_dedup": op10,
    "op11_fill_middle": op11,
    "op12_prefix_token_counts": op12,
    "op13_conversation_repair": op13,
    "pipeline": corpus_pipeline.run,
}
_ORACLES: dict[str, str] = {
    "op6_site_line_dedup": OP6_SQL,
    "op7_poisson_mixing": OP7_SQL,
    "op11_fill_middle": OP11_SQL,
}


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES if corpus_pipeline.ORACLE_SQL is None else _ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}
