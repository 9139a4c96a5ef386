"""Exact quantiles of large groups by distributed selection.

A quantile needs the values of two ranks. In a turn, every group with open ranks
is summarised by a mergeable sketch of bounded size, which gives evenly spaced
edges; the two edges around a wanted rank bracket it. The rows below, on and
between the edges are then counted exactly, so the sketch never decides anything:
the rank is on an edge, and known, or among the rows strictly between (or, should
the sketch be off, beyond) them, and only those rows go on. A turn leaves a few
hundredths of the rows, whatever their distribution, and a value that many
rows share is an edge sooner or later. Once no more than ``small`` rows of a rank
are open they are ranked in a window. A task holds a sketch or that many rows.

No join gathers the rows of a large group in one task: there are at most as many
large groups as ``small`` goes into the rows, so their brackets are broadcast, and
only rows of the others are dealt by group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelens.sources.staging import stage

SMALL = 4096
EDGES, ACCURACY = 256, 10_000


def _with(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the other columns of ``right`` are added."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    pairs = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, pairs), how).drop(*[f"_r_{k}" for k in keys])


def _bracketed(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (keys, want, rank) with the edges ``a`` and ``b`` around each rank."""
    steps = [i / EDGES for i in range(EDGES + 1)]
    rows = _with(rows, F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
    edges = rows.groupBy(*keys).agg(F.count("*").alias("n_open"), F.percentile_approx("v", steps, ACCURACY).alias("edges"))
    at = F.floor(F.col("rank") * EDGES / F.col("n_open"))
    low, high = F.greatest(at - 1, F.lit(0)), F.least(at + 2, F.lit(EDGES))
    return _with(wanted, edges, keys).select(
        *wanted.columns, F.get("edges", low.cast("int")).alias("a"), F.get("edges", high.cast("int")).alias("b")
    )


def _classes(bracketed: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Where each rank lies (``part``: 0 below a, 1 on a, 2 between, 3 on b, 4 above b), and its rank in there."""
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    parts = [v < a, v == a, (v > a) & (v < b), (v == b) & (a != b)]
    counts = (
        _with(rows, F.broadcast(bracketed), keys)
        .groupBy(*bracketed.columns)
        .agg(*[F.count_if(part).alias(f"n{i}") for i, part in enumerate(parts)], F.count("*").alias("n_all"))
    )
    ahead, part, inside = F.lit(0), F.lit(4), F.col("rank")
    for i in range(4):
        until = ahead + F.col(f"n{i}")
        here = (F.col("rank") > ahead) & (F.col("rank") <= until)
        part, inside = F.when(here, F.lit(i)).otherwise(part), F.when(here, F.col("rank") - ahead).otherwise(inside)
        ahead = until
    inside = F.when(F.col("rank") > ahead, F.col("rank") - ahead).otherwise(inside)
    sizes = F.array(*[F.col(f"n{i}") for i in range(4)], F.col("n_all") - ahead)
    return counts.select(
        *[c for c in bracketed.columns if c != "rank"],
        part.alias("part"),
        inside.cast("long").alias("rank"),
        F.get(sizes, part).alias("n_open"),
    )


def _inside(part: Column) -> Column:
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    return ((part == 0) & (v < a)) | ((part == 2) & (v > a) & (v < b)) | ((part == 4) & (v > b))


def values_at(values: DataFrame, wanted: DataFrame, keys: list[str], small: int = SMALL, log: list | None = None) -> DataFrame:
    """(keys, want, value): the value of rank ``rank`` for each row (keys, want, rank) of ``wanted``.

    ``values`` are staged rows (keys, v) without nulls; ranks count from 1 and
    lie inside their group; ``want`` is a number that tells the ranks of a group
    apart. ``log`` takes the number of rows dealt in each turn.
    """
    known, last, rows, own = [], [], values, keys
    place = F.row_number().over(Window.partitionBy(*keys, "want").orderBy("v"))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n_open"))
    open_ = stage(_with(wanted, sizes, keys), "quantile-ranks")
    while True:
        # At most ``small`` rows a rank; the rows of larger groups stay where they are.
        wide, few = open_.where(F.col("n_open") > small), open_.where(F.col("n_open") <= small).drop("n_open")
        rest = _with(rows, F.broadcast(wide.select(*own).distinct()), own, "left_anti")
        placed = _with(rest, few, own).withColumn("_place", place).where(F.col("_place") == F.col("rank"))
        last.append(placed.select(*keys, "want", F.col("v").alias("value")))
        if wide.isEmpty():
            break
        # A first turn compares each row with all brackets of its group; later ones have rows of their own for every rank.
        brackets = stage(_bracketed(rows, wide.drop("n_open"), own), "quantile-brackets")
        found = stage(_classes(brackets, rows, own), "quantile-parts")
        known.append(found.where("part IN (1, 3)").select(*keys, "want", F.when(F.col("part") == 1, F.col("a")).otherwise(F.col("b")).alias("value")))
        open_ = found.where("part IN (0, 2, 4)")
        rows = stage(
            _with(rows, F.broadcast(open_.select(*dict.fromkeys([*own, "want"]), "a", "b", "part")), own).where(_inside(F.col("part"))).select(*keys, "want", "v"),
            "quantile-rows",
        )
        open_ = open_.select(*keys, "want", "rank", "n_open")
        own = [*keys, "want"]
        if log is not None:
            log.append(rows.count())
    return reduce(DataFrame.unionByName, [*known, *last])


def exact_quantiles(
    df: DataFrame, column: str, fractions, *groups: str, small: int = SMALL, log: list | None = None
) -> DataFrame:
    """(groups, n_valid, quantiles): linear-interpolated quantiles of the non-null values of each group.

    Groups without values stay, with null quantiles. NaN counts as the largest value.
    """
    fractions = [float(x) for x in fractions]
    if not fractions or not all(0 <= x <= 1 for x in fractions):
        raise ValueError("fractions must be in [0, 1]")
    keys = list(groups) or ["_all"]
    named = df.select(*groups, F.col(column).cast("double").alias("v"))
    named = stage(named if groups else named.withColumn("_all", F.lit(0)), "quantile-values")
    values = named.where("v IS NOT NULL")
    counts = named.groupBy(*keys).agg(F.count("v").alias("n_valid"))
    spots = [F.struct(F.lit(i).alias("q"), (F.lit(x) * (F.col("n_valid") - 1)).alias("spot")) for i, x in enumerate(fractions)]
    spots = counts.where("n_valid > 0").select(*keys, F.inline(F.array(*spots)))
    ends = [F.struct((2 * F.col("q") + i).alias("want"), (f("spot") + 1).cast("long").alias("rank")) for i, f in enumerate((F.floor, F.ceil))]
    found = values_at(values, spots.select(*keys, F.inline(F.array(*ends))), keys, small, log)
    below, above = F.max(F.when(F.col("want") % 2 == 0, F.col("value"))), F.max(F.when(F.col("want") % 2 == 1, F.col("value")))
    both = found.groupBy(*keys, F.expr("want div 2").alias("q")).agg(below.alias("below"), above.alias("above"))
    spot = F.element_at(F.array(*[F.lit(x) for x in fractions]), (F.col("q") + 1).cast("int")) * (F.col("n_valid") - 1)
    share = spot - F.floor(spot)
    value = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise((1 - share) * F.col("below") + share * F.col("above"))
    cells = _with(both, counts, keys).select(*keys, "q", value.alias("value")).groupBy(*keys)
    lists = cells.agg(*[F.max(F.when(F.col("q") == i, F.col("value"))).alias(f"_q{i}") for i in range(len(fractions))])
    out = _with(counts, lists, keys, "left")
    return out.select(*groups, "n_valid", F.array(*[F.col(f"_q{i}") for i in range(len(fractions))]).alias("quantiles"))
