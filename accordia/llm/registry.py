"""The operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html_text import op10_html_extraction
from .langid import op2_language_id
from .lm import op4_lm_scoring
from .media import op8_media_columns
from .neardup import op6_minhash_near_dedup
from .packing import op7_best_fit_packing
from .pieces import op3_sentencepiece_nbest
from .quality import op1_quality_rules
from .token_output import op5_token_output
from . import quality, url_rules
from .url_rules import op9_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_sentencepiece_nbest, op4_lm_scoring, op5_token_output, op6_minhash_near_dedup, op7_best_fit_packing, op8_media_columns, op9_url_filters, op10_html_extraction)}
ORACLES: dict[str, str] = {"op1_quality_rules": quality.oracle(), "op9_url_filters": url_rules.ORACLE}
