"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Catalyst shares no common subexpression inside lambda functions, and
    collapsing projections may inline an expensive column into each of its
    uses; binding it to the lambda variable of a one-element array keeps it a
    single evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 512) -> Column:
    """Concatenated outputs of a running state over ``items`` (one array expression, no null).

    ``step(state, item)`` gives the next state and an array of outputs.  Outputs
    are gathered block by block, so an array of n items copies about n * block
    / 2 references instead of n * n / 2.
    """

    def run(xs: Column) -> Column:
        def empty() -> Column:
            return F.filter(F.flatten(F.transform(F.slice(xs, 1, 1), lambda x: step(start, x)[1])), lambda _: F.lit(False))

        def inner(state: Column, part: Column) -> Column:
            def one(s: Column, x: Column) -> Column:
                after, out = step(s["last"], x)
                return F.struct(after.alias("last"), F.concat(s["out"], out).alias("out"))

            return F.aggregate(part, F.struct(state.alias("last"), empty().alias("out")), one)

        def outer(s: Column, b: Column) -> Column:
            part = F.slice(xs, b * block + 1, block)
            return let(inner(s["last"], part), lambda r: F.struct(r["last"].alias("last"), F.concat(s["out"], F.array(r["out"])).alias("out")))

        none = F.filter(F.array(empty()), lambda _: F.lit(False))
        blocks = F.sequence(F.lit(0), F.floor(F.size(xs) / block).cast("int"))
        return F.flatten(F.aggregate(blocks, F.struct(start.alias("last"), none.alias("out")), outer, lambda s: s["out"]))

    return let(items, run)
