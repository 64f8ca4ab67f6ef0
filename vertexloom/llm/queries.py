"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op3_decontamination
from .langid import op7_language
from .mixing import OP6_SQL, op6_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .quality import op10_quality
from .secrets import op4_secrets
from .substrings import OP2_SQL, op2_substrings
from .suffixes import OP5_SQL, op5_suffixes
from .topk import OP8_SQL, op8_topk
from .toxicity import op9_toxicity

OPERATORS = [
    op1_ngram_join, op2_substrings, op3_decontamination, op4_secrets, op5_suffixes,
    op6_mixing, op7_language, op8_topk, op9_toxicity, op10_quality,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_substrings": OP2_SQL, "op5_suffixes": OP5_SQL, "op6_mixing": OP6_SQL, "op8_topk": OP8_SQL}
