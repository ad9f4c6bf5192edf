"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wicker.llm.bpe import op6_bpe
from wicker.llm.embedding_dedup import op5_embedding_dedup
from wicker.llm.filter_audit import OP12_SQL, op12_filter_audit
from wicker.llm.langid import op10_language_id
from wicker.llm.line_dedup import op1_line_dedup
from wicker.llm.lm_scoring import op3_lm_scoring
from wicker.llm.mixing import OP7_SQL, op7_mixing
from wicker.llm.ngram_join import op8_ngram_join
from wicker.llm.quality import op4_quality
from wicker.llm.sharding import op2_sharding
from wicker.llm.url_filter import op11_url_filter
from wicker.llm.whitening import op13_whitening
from wicker.llm.winnowing import op9_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_line_dedup, op2_sharding, op3_lm_scoring, op4_quality, op5_embedding_dedup, op6_bpe, op7_mixing, op8_ngram_join, op9_winnowing, op10_language_id, op11_url_filter, op12_filter_audit, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op12_filter_audit": OP12_SQL}
