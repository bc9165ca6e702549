"""Array expressions for the gap-sensitive window distance.

A window side is addressed by its offset ``j >= 1`` from the pivot. ``q_at(j)``
and ``h_at(j)`` give the value of the query and of the candidate there, NULL
where the slot is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

At = Callable[[Column], Column]


def joint_offsets(q_at: At, h_at: At, width: int, keep: int, own: Column) -> Column:
    """The ``keep`` nearest offsets at which both sides are observed.

    At offset ``own`` the candidate's window meets the query itself, which is missing.
    """
    offsets = F.sequence(F.lit(1), F.lit(width))
    both = F.filter(
        offsets, lambda j: q_at(j).isNotNull() & h_at(j).isNotNull() & (j != own))
    return F.slice(both, 1, keep)


def side_sums(kept: Column, q_at: At, h_at: At, d: int) -> tuple[Column, Column]:
    """Weighted difference and weight of one side for its ``d`` nearest offsets.

    The weight of offset ``j`` is ``far + near - j`` with the farthest and the
    nearest kept offset. An empty side gives 0 and 0.
    """
    near_d = F.slice(kept, 1, d)
    ends = F.get(kept, F.lit(0)) + F.get(kept, F.least(F.size(kept), F.lit(d)) - 1)
    diff = F.aggregate(
        near_d,
        F.lit(0.0),
        lambda acc, j: acc + (ends - j) * F.abs(q_at(j) - h_at(j)),
    )
    weight = F.aggregate(near_d, F.lit(0), lambda acc, j: acc + (ends - j))
    return diff, weight


def ratio(diffs: list[Column], weights: list[Column]) -> Column:
    """Weighted mean over both sides; NULL when no offset is shared."""
    num = diffs[0] + diffs[1]
    den = weights[0] + weights[1]
    return F.when(den > 0, num / den)


def shift_rank(shift: Column) -> Column:
    """Position in the order 0, -1, 1, -2, 2, ..."""
    return F.when(shift < 0, -2 * shift - 1).otherwise(2 * shift).cast("int")
