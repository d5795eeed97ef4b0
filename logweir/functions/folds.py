"""Folds over arrays that give a row for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512


def scan(items: Column, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], row: str) -> Column:
    """What ``step(state, item)`` gives beside the next state for each of ``items``, which are not empty.

    Results grow in blocks, since an array is copied whenever it grows: the cost
    is in proportion to the number of items up to ``BLOCK`` squared of them.
    """
    names = list(start)

    def one(state: Column, item: Column) -> Column:
        after, out = step(state, item)
        return F.struct(*(after[n].alias(n) for n in names), F.concat(state["out"], F.array(out)).alias("out"))

    def block(state: Column, at: Column) -> Column:
        begin = F.struct(*(state[n].alias(n) for n in names), F.array().cast(f"array<{row}>").alias("out"))
        inner = F.aggregate(F.slice(items, at, F.lit(BLOCK)), begin, one)
        grown = lambda s: F.struct(*(s[n].alias(n) for n in names), F.concat(state["outs"], F.array(s["out"])).alias("outs"))
        return F.get(F.transform(F.array(inner), grown), F.lit(0))  # bound once, as several fields are taken from it

    init = F.struct(*(start[n].alias(n) for n in names), F.array().cast(f"array<array<{row}>>").alias("outs"))
    return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), init, block)["outs"])
