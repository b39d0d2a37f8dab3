"""Cover density: how closely a text has a query's words together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def cover_density(tokens: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Sum over the shortest runs of tokens that meet every group of 1 / (1 + the other tokens in the run); 0 without any.

    One pass over the tokens that meet a group, in texts that meet all of them: at each the run begins at the earliest of the groups'
    latest places; it is a shortest one if none that began there came before.
    """
    if not groups:
        return F.lit(0.0)
    n = len(groups)
    start = F.struct(*[F.lit(-1).alias(f"g{k}") for k in range(n)], F.lit(-1).alias("left"), F.lit(0.0).alias("sum"))
    members = [t for g in groups for t in g]

    def step(acc: Column, token: Column) -> Column:
        met = [token["t"].isin(*g) for g in groups]
        latest = [F.when(m, token["i"]).otherwise(acc[f"g{k}"]) for k, m in enumerate(met)]
        left = F.least(*latest) if n > 1 else latest[0]
        new = reduce(lambda a, b: a | b, met) & (left > acc["left"])
        gain = F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0), token["i"] - left - (n - 1)))
        return F.struct(*[v.alias(f"g{k}") for k, v in enumerate(latest)], F.when(new, left).otherwise(acc["left"]).alias("left"), F.when(new, acc["sum"] + gain).otherwise(acc["sum"]).alias("sum"))

    def density(words: Column) -> Column:
        placed = F.filter(F.transform(words, lambda t, i: F.struct(t.alias("t"), i.cast("int").alias("i"))), lambda p: p["t"].isin(*members))
        every = reduce(lambda a, b: a & b, [F.arrays_overlap(words, F.array(*map(F.lit, g))) for g in groups])
        return F.when(every, F.aggregate(placed, start, step)["sum"])

    # an array of one, so that the tokens are found once
    return F.coalesce(F.get(F.transform(F.array(tokens), density), F.lit(0)), F.lit(0.0))
