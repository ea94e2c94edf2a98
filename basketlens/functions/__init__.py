"""Column expressions: everything here stays in the JVM."""

from basketlens.functions.dates import check_dt, day_of, day_shift, previous_day
from basketlens.functions.scoring import weighted_score
from basketlens.functions.sentiment import CHINESE, Lexicon, sentiment_label, sentiment_score
from basketlens.functions.wilson import wilson_lower

__all__ = [
    "CHINESE",
    "Lexicon",
    "check_dt",
    "day_of",
    "day_shift",
    "previous_day",
    "sentiment_label",
    "sentiment_score",
    "weighted_score",
    "wilson_lower",
]
