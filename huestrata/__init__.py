"""Colour-histogram time series from fixed cameras, as native Spark jobs."""

from huestrata.operators.kernels import kernel_of, kernel_windows
from huestrata.operators.merge import weighted_day_merge
from huestrata.operators.windows import multi_day_window
from huestrata.plans.cpm import (
    daily_cpm,
    facet_style,
    hourly_cpm,
    kernel_cpm,
    noon_cpm,
    share_cpm,
    weighted_cpm,
    window_cpm,
    with_palette,
)
from huestrata.plans.profiles import (
    bin_distribution,
    kernel_profile,
    mean_coefficients,
    parse_image_name,
    timing_summary,
    weight_profile,
)
from huestrata.plans.uncertainty import hourly_distance, relative_uncertainty, uncertainty
from huestrata.sources.files import (
    read_histogram_csv,
    read_histograms,
    read_numbered,
    read_palette,
    read_plain_csv,
    read_share_csv,
    read_timing_csv,
    write_histograms,
    write_table,
)

__all__ = [
    "bin_distribution",
    "daily_cpm",
    "facet_style",
    "hourly_cpm",
    "hourly_distance",
    "kernel_cpm",
    "kernel_of",
    "kernel_profile",
    "kernel_windows",
    "mean_coefficients",
    "multi_day_window",
    "noon_cpm",
    "parse_image_name",
    "read_histogram_csv",
    "read_histograms",
    "read_numbered",
    "read_palette",
    "read_plain_csv",
    "read_share_csv",
    "read_timing_csv",
    "relative_uncertainty",
    "share_cpm",
    "timing_summary",
    "uncertainty",
    "weight_profile",
    "weighted_cpm",
    "weighted_day_merge",
    "window_cpm",
    "with_palette",
    "write_histograms",
    "write_table",
]
