from huestrata.functions.color import rgb_to_hex, with_hsv_hex
from huestrata.functions.nulls import (
    clean_nan,
    lenient_sum,
    strict_max_over,
    strict_sum,
    strict_sum_over,
)
from huestrata.functions.numbers import as_integer, case_of, hour_weight, whole_div, year_days
from huestrata.functions.text import hour_label, paste, window_label

__all__ = [
    "as_integer",
    "case_of",
    "clean_nan",
    "hour_label",
    "hour_weight",
    "lenient_sum",
    "paste",
    "rgb_to_hex",
    "strict_max_over",
    "strict_sum",
    "strict_sum_over",
    "whole_div",
    "window_label",
    "with_hsv_hex",
    "year_days",
]
