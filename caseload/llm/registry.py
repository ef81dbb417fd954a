"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

import corpus_pipeline

from . import (decontaminate, exact_dedup, fill_middle, language, line_dedup, near_dedup, packing, pii, quality, resampling,
               simhash, substring_dedup, url_filter)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_pii": pii.op2_pii,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_language": language.op5_language,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_resampling": resampling.op12_resampling,
    "op13_simhash": simhash.op13_simhash,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op7_line_dedup": line_dedup.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_fill_middle": fill_middle.SQL,
}
