"""Regime classification as one ordered CASE expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import FAST_RESOLVE_BELOW, NO_DATA_COMPLETENESS, REGIME_CELLS, REGIMES


def _in_cell(b: Column, bp: Column, cell: tuple) -> Column:
    b_min, b_max, b_incl, bp_min, bp_max, bp_incl, _ = cell
    tests = [F.lit(True)]
    if b_min is not None:
        tests.append(b >= b_min)
    if b_max is not None:
        tests.append(b <= b_max if b_incl else b < b_max)
    if bp_min is not None:
        tests.append(bp >= bp_min)
    if bp_max is not None:
        tests.append(bp <= bp_max if bp_incl else bp < bp_max)
    return reduce(lambda left, right: left & right, tests)


def classify(b: Column, bp: Column, completeness: Column, cells: list[tuple] = REGIME_CELLS) -> Column:
    """First matching cell wins, STABLE if none does, NO_DATA below the gate."""
    gate = completeness.isNull() | (completeness < NO_DATA_COMPLETENESS) | b.isNull() | bp.isNull()
    label = F.when(gate, "NO_DATA")
    for cell in cells:
        label = label.when(_in_cell(b, bp, cell), cell[-1])
    return label.otherwise("STABLE")


def fast_resolve(regime: Column, bp: Column) -> Column:
    """A RESOLVING segment that loosens very quickly."""
    return F.coalesce((regime == "RESOLVING") & (bp < FAST_RESOLVE_BELOW), F.lit(False))


def parse_regime(text: Column) -> Column:
    """Unknown labels read back as NO_DATA."""
    return F.when(text.isin(*REGIMES), text).otherwise("NO_DATA")
