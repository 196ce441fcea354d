"""The operator queries and the corpus pipeline, for registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .decontaminate import op5_decontaminate
from .html_text import op1_html
from .licenses import OP4_SQL, op4_licenses
from .media import op6_media
from .near_dup import OP8_SQL, op8_near_dup
from .quality import op9_quality
from .simhash import op12_simhash
from .spelling import op13_spelling
from .substring import OP2_SQL, op2_substring
from .token_store import op7_token_store
from .toxicity import op10_toxicity
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_substring": op2_substring,
    "op3_bpe": op3_bpe,
    "op4_licenses": op4_licenses,
    "op5_decontaminate": op5_decontaminate,
    "op6_media": op6_media,
    "op7_token_store": op7_token_store,
    "op8_near_dup": op8_near_dup,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {"op2_substring": OP2_SQL, "op4_licenses": OP4_SQL, "op8_near_dup": OP8_SQL}
