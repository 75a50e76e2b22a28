"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from msgpipe.llm import oracle
from msgpipe.llm.decontaminate import op8_decontamination
from msgpipe.llm.embeddings import op5_embedding_pca
from msgpipe.llm.language_id import op11_language_id
from msgpipe.llm.line_dedup import op3_line_dedup
from msgpipe.llm.paragraphs import op4_substring_dedup
from msgpipe.llm.personal_data import op6_personal_data
from msgpipe.llm.piece_bpe import op2_sentencepiece
from msgpipe.llm.resampling import op12_importance_resampling
from msgpipe.llm.simhash import op7_simhash
from msgpipe.llm.token_files import op9_token_files
from msgpipe.llm.toxicity import op1_toxicity
from msgpipe.llm.url_rules import op10_url_rules
from msgpipe.llm.vector_codes import op13_vector_codes
from msgpipe.session import configure

_OPERATORS = (
    op1_toxicity, op2_sentencepiece, op3_line_dedup, op4_substring_dedup, op5_embedding_pca,
    op6_personal_data, op7_simhash, op8_decontamination, op9_token_files, op10_url_rules,
    op11_language_id, op12_importance_resampling, op13_vector_codes,
)


def _configured(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


QUERIES = {query.__name__: _configured(query) for query in _OPERATORS} | {
    "pipeline": corpus_pipeline.run}
ORACLE = oracle.SQL | (
    {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
