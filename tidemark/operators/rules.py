"""The decision rules, each a struct Column over a group's baseline values: null where the rule is silent.

values: array<double>, one for each baseline run that has the measure. n: how many baseline runs there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import evidence, mad_of, median_of, round_sig

# The rules' thresholds.
MIN_RUNS = 2
LATENCY_FLOOR_MS, LATENCY_RATIO = 100.0, 4.0
NEIGHBOUR_SHARE, COHORT_PEERS = 0.5, 3
STALL_SPREADS, MAD_TO_SIGMA = 3.0, 1.4826
VARYING_WIDTHS = 2.0

#: Signal kinds in the order that breaks ties.
KINDS = ("incomplete", "error", "new", "disappeared", "frequency", "latency")


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def presence(now: Column, present_in: Column, n: Column) -> Column:
    """new: here now, in no baseline run; disappeared: in all of them, not here. In some of them is no news."""
    kind = F.when(now & (present_in == 0), F.lit("new")).when(~now & (present_in == n), F.lit("disappeared"))
    return F.when((n >= MIN_RUNS) & kind.isNotNull(), F.struct(kind.alias("kind"), round_sig(evidence(n), 2).alias("confidence")))


def frequency(values: Column, current: Column) -> Column:
    """Outside the range of all baseline runs: at once where they agree, else by more than two range widths."""
    n, low, high, middle = F.size(values), F.array_min(values), F.array_max(values), median_of(values)
    width, distance = high - low, F.abs(current - middle)
    exact = low == high
    fires = (n >= MIN_RUNS) & ((current < low) | (current > high)) & (exact | (distance > VARYING_WIDTHS * width))
    sure = round_sig(evidence(n) * F.when(exact, 1.0).otherwise(1.0 - width / distance), 2)
    return F.when(fires, F.struct(exact.alias("exact"), middle.alias("median"), low.alias("min"), high.alias("max"), sure.alias("confidence")))


def error(errors: Column, failures: Column, n: Column, known: Column) -> Column:
    """A failure now, where `failures` of the n runs that ran it failed too; known: one of those failed in the same way."""
    sure = 1.0 - (failures.cast("double") + 1.0) / (n.cast("double") + 2.0)
    return F.when((errors > 0) & (n > 0) & ~((failures > 0) & known), F.struct(round_sig(sure, 2).alias("confidence")))


def incomplete(n: Column) -> Column:
    return F.when(n > 0, F.struct(round_sig(evidence(n), 2).alias("confidence")))


def stalled(window: Column, window_now: Column, excess: Column) -> Column:
    """Whether the rest of the run slowed by more than this did, beyond its usual spread. False for an empty window."""
    rest = (window_now - median_of(window)) - excess
    return F.coalesce((rest > excess) & (rest > STALL_SPREADS * MAD_TO_SIGMA * mad_of(window)), F.lit(False))


def latency(values: Column, current: Column, neighbour: Column | None = None, slowdowns: Column | None = None, window: tuple[Column, Column, Column] | None = None) -> Column:
    """Mean milliseconds far above those of the baseline runs that timed it, unless the machine stalled.

    neighbour: the largest slowdown of the examples run just before and after. slowdowns: those of all examples, this
    one among them. window: (baseline totals, the total now, what this accounts for of the change).
    """
    n, low, high, middle = F.size(values), F.array_min(values), F.array_max(values), median_of(values)
    need, delta = F.greatest(F.lit(LATENCY_FLOOR_MS), (LATENCY_RATIO - 1.0) * middle), current - middle
    fires = (n >= MIN_RUNS) & (delta > need) & (current > high) & (delta > VARYING_WIDTHS * (high - low))
    if neighbour is not None:
        fires &= F.coalesce(neighbour, F.lit(0.0)) < NEIGHBOUR_SHARE * delta
    if slowdowns is not None:
        fires &= F.coalesce(F.size(F.filter(slowdowns, lambda s: s >= NEIGHBOUR_SHARE * delta)), F.lit(0)) - 1 < COHORT_PEERS
    if window is not None:
        fires &= ~stalled(*window)
    e = delta / need
    return F.when(fires, F.struct(middle.alias("median"), round_sig(evidence(n) * e / (1.0 + e), 2).alias("confidence")))
