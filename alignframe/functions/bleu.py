"""BLEU from n-gram counts.

Score = brevity penalty * exp(mean of ln p_n), n = 1..4 (Papineni et al. 2002). An order without a match gets
1 / (2^k * total), k counting such orders so far (exponential smoothing, Chen and Cherry 2014).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ORDER = 4


def score(hyp_len: Column, ref_len: Column, matches: list[Column], totals: list[Column],
          effective_order: bool = True) -> Column:
    """BLEU in 0..1 from counts of one row or of a whole group.

    Without ``effective_order`` a text too short for some order scores 0, as in corpus scoring.
    """
    zero_orders = F.lit(0)
    log_sum, used = F.lit(0.0), F.lit(0)
    for m, t in zip(matches, totals):
        zero_orders = zero_orders + F.when((m == 0) & (t > 0), 1).otherwise(0)
        smoothed = F.when(m > 0, m.cast("double") / t).otherwise(
            F.lit(1.0) / (F.pow(F.lit(2.0), zero_orders) * t)
        )
        log_sum = log_sum + F.when(t > 0, F.ln(smoothed)).otherwise(0.0)
        used = used + F.when(t > 0, 1).otherwise(0)
    brevity = F.when(hyp_len >= ref_len, F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - ref_len.cast("double") / hyp_len)
    )
    any_match = sum((m for m in matches[1:]), matches[0]) > 0
    defined = any_match if effective_order else any_match & (used == MAX_ORDER)
    return F.when(defined, brevity * F.exp(log_sum / used)).otherwise(F.lit(0.0))
