from tablewright.functions.dates import days_between, days_since, parse_date, weekday
from tablewright.functions.numeric import clean_ratio, deviation, ratio
from tablewright.functions.vectors import entropy, equal_width_bins, exposure, bin_counts, spread

__all__ = [
    "bin_counts",
    "clean_ratio",
    "days_between",
    "days_since",
    "deviation",
    "entropy",
    "equal_width_bins",
    "exposure",
    "parse_date",
    "ratio",
    "spread",
    "weekday",
]
