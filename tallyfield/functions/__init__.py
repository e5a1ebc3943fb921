from .joins import broadcast_if_small, fits_broadcast
from .measures import exact_total, mean_of, month_label, month_start, sum_in_any_order
from .running import beside_ranges, range_number, ranged, running_total
from .text import (
    base64_line,
    column_named,
    dotted_name,
    last_part,
    literal_search,
    or_default,
    or_null,
    yes_no,
)

__all__ = [
    "base64_line",
    "beside_ranges",
    "broadcast_if_small",
    "column_named",
    "dotted_name",
    "exact_total",
    "fits_broadcast",
    "last_part",
    "literal_search",
    "mean_of",
    "month_label",
    "month_start",
    "or_default",
    "or_null",
    "range_number",
    "ranged",
    "running_total",
    "sum_in_any_order",
    "yes_no",
]
