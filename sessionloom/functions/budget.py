"""Usable tokens, pressure, its state, and the targets of a plan, in single precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRESSURES, Context
from .text import f32, ratio32


def minus(a: Column, b: Column) -> Column:
    """a - b, but at least 0."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def usable(window: Column, reserved: Column, safety: Column) -> Column:
    return minus(minus(window, reserved), safety)


def pressure(current: Column, usable_tokens: Column) -> Column:
    return ratio32(current, usable_tokens)


def pressure_state(p: Column, c: Context) -> Column:
    out = F.lit(PRESSURES[0])
    for name, mark in zip(PRESSURES[1:], (c.observe, c.trim, c.compact, c.aggressive, c.emergency), strict=True):
        out = F.when(p >= f32(mark), F.lit(name)).otherwise(out)
    return out


def needs_compaction(state: Column) -> Column:
    return state.isin("Compact", "Aggressive", "Emergency")


def share(part: float, usable_tokens: Column) -> Column:
    """The whole tokens of a share of the usable ones."""
    return (f32(part) * f32(usable_tokens)).cast("long")
