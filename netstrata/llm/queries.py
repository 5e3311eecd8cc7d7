"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fim import OP12_SQL, op12_fill_in_middle
from .langid import op10_language_id
from .lines import OP9_SQL, op9_line_dedup
from .media import op7_media_columns
from .neighbours import op13_nearest_neighbours
from .packing import op5_packing
from .pieces import op4_sentencepiece
from .quality import OP3_SQL, op3_quality_rules
from .simhash import op6_simhash
from .suffix import op8_suffix_dedup
from .tokens import op2_token_output
from .urls import op1_url_filter
from .vectorcode import OP11_SQL, op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_output": op2_token_output,
        "op3_quality_rules": op3_quality_rules,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_packing": op5_packing,
        "op6_simhash": op6_simhash,
        "op7_media_columns": op7_media_columns,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_language_id": op10_language_id,
        "op11_vector_codes": op11_vector_codes,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op9_line_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
