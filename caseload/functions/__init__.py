"""Scalar column functions."""

from caseload.functions.scalars import (  # noqa: F401
    birth_year,
    capitalize,
    case_label,
    clipped_size,
    col_or,
    first_present,
    flag,
    json_array_span,
    json_object_span,
    labels_of,
    num,
    occupation_bucket,
    row_max_is_one,
    size_bonus,
    with_strict_json,
    inline_rows,
    sql_literal,
    text_int,
    tier,
    truncated,
    weighted_sum,
)
