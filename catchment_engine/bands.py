"""Constants of the analytics contract."""

from __future__ import annotations

from statistics import NormalDist

#: Drive-time bands in minutes, and the primary one.
CANONICAL_BANDS = (30, 60, 120, 180)
PRIMARY_ACCESS_BAND_MIN = 60
PRIMARY_ACCESS_BAND_SEC = 60 * PRIMARY_ACCESS_BAND_MIN

#: The contiguous states with the District of Columbia, and others.
CONUS_STATE_ABBR = tuple(
    "AL AR AZ CA CO CT DC DE FL GA IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY".split()
)
NON_CONTIGUOUS_CODES = ("AK", "AS", "GU", "HI", "MP", "PR", "VI")

#: Prevalence by condition at ages 65-79 and 80 and over.
WU2014_PFD_PREVALENCE = (
    ("any_PFD", 0.368, 0.497),
    ("UI", 0.272, 0.382),
    ("FI", 0.154, 0.210),
    ("POP", 0.047, 0.040),
)

#: Tolerances: populations, ratios (on the larger of 1 and the expected value), areas.
TOL_POPULATION, TOL_RELATIVE, TOL_GEOMETRY_FRACTION = 0.0, 1e-9, 1e-6

#: The first code that isn't metropolitan.
RUCA_NONMETRO_MIN = 4


def get_canonical_bands() -> tuple[int, ...]:
    return CANONICAL_BANDS


def z_value(confidence: float) -> float:
    """Two-sided standard normal quantile of a confidence level."""
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


#: A 90 % margin of error times this is a 95 % half-width.
MOE90_TO_CI95_FACTOR = NormalDist().inv_cdf(0.975) / NormalDist().inv_cdf(0.95)
