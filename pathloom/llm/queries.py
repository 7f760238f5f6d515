"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.decontamination import op7_decontamination
from pathloom.llm.html_text import op4_html_text
from pathloom.llm.mixing import op9_mixing
from pathloom.llm.near_dup import op5_near_duplicates
from pathloom.llm.pii_surrogates import op8_pii_surrogates
from pathloom.llm.quality_rules import op3_quality_rules
from pathloom.llm.token_counts import op10_token_counts
from pathloom.llm.token_files import op1_token_files
from pathloom.llm.toxicity import op2_toxicity
from pathloom.llm.url_filter import OP6_SQL, op6_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_toxicity": op2_toxicity,
        "op3_quality_rules": op3_quality_rules,
        "op4_html_text": op4_html_text,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_url_filter": op6_url_filter,
        "op7_decontamination": op7_decontamination,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_mixing": op9_mixing,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL}
