"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linecensus.llm.decontaminate import op1_benchmark_decontamination
from linecensus.llm.exact_dedup import op10_exact_dedup
from linecensus.llm.html_extract import op6_html_extraction
from linecensus.llm.jaccard_join import op11_ngram_jaccard_join
from linecensus.llm.language_id import op7_language_id
from linecensus.llm.near_dedup import op9_minhash_near_dedup
from linecensus.llm.packing import op8_best_fit_packing
from linecensus.llm.pii import op3_pii_boosting
from linecensus.llm.prefix_trie import op12_conversation_prefix_trie
from linecensus.llm.quality import op2_quality_classifier
from linecensus.llm.sharding import op4_histogram_sharding
from linecensus.llm.token_counts import op5_token_counts
from linecensus.llm.whitening import op13_embedding_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    named = (
        op1_benchmark_decontamination, op2_quality_classifier, op3_pii_boosting,
        op4_histogram_sharding, op5_token_counts, op6_html_extraction,
        op7_language_id, op8_best_fit_packing, op9_minhash_near_dedup,
        op10_exact_dedup, op11_ngram_jaccard_join, op12_conversation_prefix_trie,
        op13_embedding_whitening,
    )
    return {query.__name__: query for query in named}
