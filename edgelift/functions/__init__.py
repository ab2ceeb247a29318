"""Column functions: the generator that all sampling uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Park and Miller's multiplicative generator.
FACTOR, MODULUS = 48271, 2147483647
#: Rounds before the first draw, as states of neighbouring seeds start out correlated.
WARM_UP = 3


def step(state: Column) -> Column:
    return state * FACTOR % MODULUS


def seeded(number: Column, seed: int = 0) -> Column:
    """A state for each number, in 1 .. MODULUS - 1."""
    state = (number + seed * 7919 + 1) % (MODULUS - 1) + 1
    for _ in range(WARM_UP):
        state = step(state)
    return state


def seeded_sql(number: str, seed: int = 0) -> str:
    """The same as SQL."""
    out = f"(({number} + {seed * 7919 + 1}) % {MODULUS - 1} + 1)"
    for _ in range(WARM_UP):
        out = step_sql(out)
    return out


def step_sql(state: str) -> str:
    return f"({state} * {FACTOR} % {MODULUS})"


def bernoulli(number: Column, per_mille: int, seed: int = 0) -> Column:
    """True for about so many in a thousand numbers, always the same ones."""
    return seeded(number, seed) % 1000 < F.lit(per_mille)
