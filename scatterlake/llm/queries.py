"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytebpe import byte_bpe_query
from .jaccard import JACCARD_SQL, jaccard_query
from .langid import langid_query
from .lmscore import lm_query
from .metricjoin import METRIC_JOIN_SQL, metric_join_query
from .packing import packing_query
from .quality import quality_query
from .quotes import quotes_query
from .substrings import substring_query
from .toxicity import toxicity_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lm_query,
        "op2_quality_rules": quality_query,
        "op3_byte_bpe": byte_bpe_query,
        "op4_toxicity": toxicity_query,
        "op5_substrings": substring_query,
        "op6_metric_join": metric_join_query,
        "op7_quotation_linking": quotes_query,
        "op8_jaccard_join": jaccard_query,
        "op9_langid": langid_query,
        "op10_packing": packing_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_metric_join": METRIC_JOIN_SQL, "op8_jaccard_join": JACCARD_SQL}
