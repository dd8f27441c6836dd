"""Queries of the training-data operators and of the pipeline, with their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidewright.llm import decontaminate, exact_dedup, html_extract, jaccard_join, packing, quality, sharding, substring_dedup, url_filter, warc


def queries():
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_sharding": sharding.op2_sharding,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_quality": quality.op5_quality,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_warc": warc.op9_warc,
        "op10_url_filter": url_filter.op10_url_filter,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_sharding": sharding.SQL,
        "op3_exact_dedup": exact_dedup.SQL,
        "op6_jaccard_join": jaccard_join.SQL,
        "op7_decontaminate": decontaminate.SQL,
        "op9_warc": warc.SQL,
        "op10_url_filter": url_filter.SQL,
    }
