"""shelfwise: retail inventory analytics as Spark DataFrame functions.

Every analysis takes a :class:`~shelfwise.sources.star.Star` (a daily
stock-and-sales fact plus store, product and date dimensions) and returns a
DataFrame built from built-in Spark expressions, so Catalyst plans it and
it runs unchanged on a laptop or a cluster. Building one runs small jobs on the
calendar where a window has to be resolved, and q20-q22 write their
classification.
"""

from shelfwise.sources.staging import Stage
from shelfwise.sources.star import Star, read_star, stage_star, validate, write_star
from shelfwise.sources.tpch import derive_star, load_star, release_stars
from shelfwise.plans import ANALYSES

__all__ = [
    "ANALYSES",
    "Stage",
    "Star",
    "derive_star",
    "load_star",
    "read_star",
    "release_stars",
    "stage_star",
    "validate",
    "write_star",
]

__version__ = "0.1.0"
