"""Query-cluster bootstrap: whole query groups are drawn with replacement.

A replicate draws G of the G queries. Draws are made in two steps, so that
they never travel: first every draw picks a chunk of queries (only the counts
per replicate and chunk are shuffled), then each chunk makes its own draws
next to its queries. Pair rows are reduced to a few numbers per query before
any replicate touches them, and every statistic is a weighted sum of those
numbers, so the pairs are read once for all replicates.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelens.constants import BOOTSTRAP_BUDGET, BOOTSTRAP_REPLICATES, CONFIDENCE, SEED
from judgelens.functions.hashing import MASK_32, STREAM_STEP, mix32, mix32_array
from judgelens.operators import classification as C
from judgelens.operators.cuts import FAN, first_cuts, next_cuts, run_of, run_widths, yields_at
from judgelens.operators.numbering import number_rows
from judgelens.operators.review import check_budgets, is_error, review_metrics, review_queue
from judgelens.operators.sampling import percentile_interval
from judgelens.sources.staging import stage

CHUNK = 8192  # queries per chunk; part of what a seed means, so it never depends on the data
CELL_COUNT = len(C.CELLS)
STATISTICS = ("macro_f1", "audit_yield", "random_expected_yield", "audit_yield_minus_random")


def chunk_draws(spark: SparkSession, n_queries: int, replicates: int, seed: int, size: int = CHUNK) -> DataFrame:
    """(replicate, chunk, draws): how many of the G draws fall into each chunk.

    Draw j of a replicate becomes a 53-bit fraction of the query range, from
    two keyed mixes of j. Only counts leave the map side.
    """
    step, mask = f"{STREAM_STEP}L", f"{MASK_32}L"
    low = "j_all & " + mask
    layers = (
        {"replicate": f"id div {n_queries}L", "j_all": f"id % {n_queries}L"},
        {"j": f"({low} + (j_all >> 32) * {step}) & {mask}", "a": mix32(f"(({seed}L + replicate * {step}) & {mask})")},
        {"b": mix32(f"(a ^ {step})")},
        {"x": mix32("(j ^ a)"), "y": mix32(f"((j + b) & {mask})")},
        # The query index is floor(fraction * G); a chunk is a run of indexes.
        {"spot": f"floor(((x ^ y) * 2097152L + (y >> 11)) / 9007199254740992D * {n_queries}L)"},
    )
    draws = spark.range(0, n_queries * replicates)
    for layer in layers:
        draws = draws.select("*", *[F.expr(text).alias(name) for name, text in layer.items()])
    chunk = F.expr(f"CAST(spot AS BIGINT) div {size}L")
    return draws.groupBy("replicate", chunk.alias("chunk")).agg(F.count("*").alias("draws"))


def draw_weights(replicate: int, chunk: int, draws: int, size: int, seed: int) -> np.ndarray:
    """How often each of the ``size`` positions of a chunk is drawn by a replicate."""
    key = lambda value: mix32_array(np.array([value & MASK_32], dtype=np.uint64))
    stream = int(key(seed + replicate * STREAM_STEP)[0])
    first = key(stream + (chunk + 1) * STREAM_STEP)
    second = key(int(first[0]) ^ STREAM_STEP)
    t = np.arange(1, draws + 1, dtype=np.uint64)
    mixed = mix32_array(t ^ first) ^ mix32_array((t + second) & np.uint64(MASK_32))
    positions = (mixed * np.uint64(size)) >> np.uint64(32)
    return np.bincount(positions.astype(np.int64), minlength=size)


class Resampler:
    """Scored pairs reduced to what the replicates need.

    ``queries`` has the dense index of every query with its chunk and position.
    ``fan`` is the number of runs of ranks that the cut of a replicate is looked for in per turn.
    """

    def __init__(
        self,
        scored: DataFrame,
        replicates: int = BOOTSTRAP_REPLICATES,
        seed: int = SEED,
        chunk: int = CHUNK,
        fan: int = FAN,
    ):
        if replicates < 1:
            raise ValueError("the number of replicates must be positive")
        self.spark = scored.sparkSession
        self.scored = scored
        self.seed = seed
        numbered = number_rows(scored.select("query_id").distinct(), ["query_id"], "query_number")
        self.n_queries = numbered.count()
        self.size = chunk
        self.fan = fan
        index = F.col("query_number") - 1
        self.queries = numbered.select(
            "query_id",
            F.floor(index / self.size).cast("bigint").alias("chunk"),
            (index % self.size).alias("position"),
        )
        # One query says nothing about the variation across queries.
        self.replicates = replicates if self.n_queries >= 2 else 0
        self.draws = stage(chunk_draws(self.spark, max(self.n_queries, 1), self.replicates, seed, chunk), "draws")

    def per_chunk(self, rows: DataFrame, fill, schema: str) -> DataFrame:
        """Bring (chunk, ...) rows and the draws of the chunk together in one task.

        A chunk holds a bounded number of queries. The number of tasks is set
        here, since the few bytes of the draw counts say nothing about the work.
        """
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.repartition(tasks, "chunk").groupBy("chunk")
        return placed.cogroup(self.draws.repartition(tasks, "chunk").groupBy("chunk")).applyInPandas(fill, schema)

    def weigher(self):
        """A plain function for the tasks: the weights of one replicate in one chunk."""
        n_queries, size, seed = self.n_queries, self.size, self.seed

        def weights(chunk: int, replicate: int, draws: int) -> np.ndarray:
            members = min(size, n_queries - chunk * size)
            return draw_weights(replicate, chunk, draws, members, seed)

        return weights

    def cluster_weights(self) -> DataFrame:
        """How often each query is drawn in each replicate; zero weights are left out."""
        weights = self.weigher()
        kind = self.scored.schema["query_id"].dataType.simpleString()

        def fill(members: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
            parts = [pd.DataFrame({"replicate": [], "query_id": [], "weight": []})]
            position = members["position"].to_numpy()
            for chunk, replicate, count in draws[["chunk", "replicate", "draws"]].itertuples(index=False):
                drawn = weights(chunk, replicate, count)[position]
                kept = drawn > 0
                parts.append(
                    pd.DataFrame(
                        {"replicate": replicate, "query_id": members["query_id"][kept], "weight": drawn[kept]}
                    )
                )
            return pd.concat(parts[1:] or parts)

        return self.per_chunk(self.queries, fill, f"replicate bigint, query_id {kind}, weight bigint")

    def weighted_sums(self, entries: DataFrame, spans: dict[int, tuple[int, int]] | None = None) -> DataFrame:
        """(replicate, feature) totals of per-query values under the drawn weights.

        ``entries`` are (chunk, position, feature, value) rows. With ``spans``,
        a replicate sums only the features from its first to before its second number.
        """
        weights = self.weigher()

        def fill(rows: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("feature", ignore_index=True)
            features, code = np.unique(rows["feature"].to_numpy(), return_inverse=True)
            starts = np.append(np.searchsorted(code, np.arange(len(features))), len(code))
            position, value = rows["position"].to_numpy(), rows["value"].to_numpy()
            out = [pd.DataFrame({"replicate": [], "feature": [], "total": []})]
            for chunk, replicate, count in draws[["chunk", "replicate", "draws"]].itertuples(index=False):
                low, high = 0, len(features)
                if spans is not None:
                    low, high = np.searchsorted(features, spans.get(replicate, (0, 0)))
                if low >= high:
                    continue
                some = slice(starts[low], starts[high])
                drawn = weights(chunk, replicate, count)[position[some]]
                totals = np.bincount(code[some] - low, weights=drawn * value[some], minlength=high - low)
                at = np.flatnonzero(totals)
                out.append(
                    pd.DataFrame({"replicate": replicate, "feature": features[low:high][at], "total": totals[at].astype(np.int64)})
                )
            return pd.concat(out[1:] or out)

        partial = self.per_chunk(entries, fill, "replicate bigint, feature bigint, total bigint")
        return partial.groupBy("replicate", "feature").agg(F.sum("total").alias("total"))

    def cell_entries(self) -> DataFrame:
        """The non-zero contingency cells of each query as features 0 to 15."""
        cells = [F.struct(F.lit(i).cast("bigint").alias("feature"), F.col(n).alias("value")) for i, n in enumerate(C.CELLS)]
        return (
            C.query_contingency(self.scored)
            .join(self.queries, "query_id")
            .select("chunk", "position", F.inline(F.array(*cells)))
            .filter("value > 0")
        )

    def queue_entries(self, queue: DataFrame, width: int) -> DataFrame:
        """Items and errors of each query per run of ranks, as two features a run."""
        counted = queue.groupBy("query_id", run_of(width).alias("run")).agg(
            F.count("*").alias("items"), F.sum("is_error").alias("errors")
        )
        base = CELL_COUNT + 2 * F.col("run")
        pair = F.array(
            F.struct(base.alias("feature"), F.col("items").alias("value")),
            F.struct((base + 1).alias("feature"), F.col("errors").alias("value")),
        )
        placed = counted.join(self.queries, "query_id")
        return placed.select("chunk", "position", F.inline(pair)).filter("value > 0")

    def macro_f1(self) -> DataFrame:
        return macro_f1_of(self.weighted_sums(self.cell_entries()))

    def ranked(self, queue: DataFrame | None = None) -> DataFrame:
        queue = review_queue(self.scored) if queue is None else queue
        return queue.select("query_id", "queue_rank", "label", is_error().cast("bigint").alias("is_error"))

    def audit_yield(self, budget: float) -> DataFrame:
        queue = self.ranked()
        widths = run_widths(queue.count(), self.fan)
        sums = stage(self.weighted_sums(self.queue_entries(queue, widths[0])), "bootstrap-sums")
        return self.yields_of(queue, widths, sums, budget)

    def yields_of(self, queue: DataFrame, widths: list[int], sums: DataFrame, budget: float) -> DataFrame:
        """Priority and random yield of each replicate; those without a budget are left out.

        All replicates descend together. A turn takes the rows of the runs that any
        of them has open, and gives at most ``fan`` runs per replicate and chunk.
        """
        check_budgets([budget])
        cuts = stage(first_cuts(run_sums_of(sums), "replicate", [budget]), "cuts")
        for wide, width in zip(widths, widths[1:]):
            # One run per replicate.
            runs = {row["replicate"]: row["run"] for row in cuts.select("replicate", "run").collect()}
            open_runs = F.broadcast(cuts.select(F.col("run").alias("_parent")).distinct())
            queue = stage(queue.withColumn("_parent", run_of(wide)).join(open_runs, "_parent", "left_semi").drop("_parent"), "cut-queue")
            spans = {k: (CELL_COUNT + 2 * run * self.fan, CELL_COUNT + 2 * (run + 1) * self.fan) for k, run in runs.items()}
            below = run_sums_of(self.weighted_sums(self.queue_entries(queue, width), spans))
            cuts = stage(next_cuts(cuts, below, "replicate", self.fan), "cuts")
        return yields_at(cuts, "replicate").select(
            "replicate",
            "n_reviewed",
            "priority_yield",
            "random_yield",
            (F.col("priority_yield") - F.col("random_yield")).alias("difference"),
        )


def run_sums_of(sums: DataFrame) -> DataFrame:
    """(replicate, run, items, errors) from the features of runs."""
    run = F.expr(f"(feature - {CELL_COUNT}) div 2")
    total = lambda odd: F.sum(F.when(F.col("feature") % 2 == odd, F.col("total")).otherwise(0))
    rows = sums.filter(F.col("feature") >= CELL_COUNT).groupBy("replicate", run.alias("run"))
    return rows.agg(total(CELL_COUNT % 2).alias("items"), total(1 - CELL_COUNT % 2).alias("errors"))


def macro_f1_of(sums: DataFrame) -> DataFrame:
    """Macro-F1 of each replicate from its 16 weighted cells."""
    cells = [F.sum(F.when(F.col("feature") == i, F.col("total")).otherwise(0)).alias(n) for i, n in enumerate(C.CELLS)]
    return (
        sums.filter(F.col("feature") < CELL_COUNT)
        .groupBy("replicate")
        .agg(*cells)
        .select("replicate", C.macro_f1().alias("macro_f1"))
    )


def cluster_weights(scored: DataFrame, replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    return Resampler(scored, replicates, seed).cluster_weights()


def bootstrap_macro_f1(scored: DataFrame, replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    return Resampler(scored, replicates, seed).macro_f1()


def bootstrap_audit_yield(
    scored: DataFrame,
    budget: float = BOOTSTRAP_BUDGET,
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    return Resampler(scored, replicates, seed).audit_yield(budget)


def bootstrap_intervals(
    scored: DataFrame,
    budget: float = BOOTSTRAP_BUDGET,
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = SEED,
    confidence: float = CONFIDENCE,
    queue: DataFrame | None = None,
) -> DataFrame:
    """Point, percentile bounds and valid replicates of the four statistics.

    Always four rows; with fewer than two queries the bounds are null and the
    status says so. ``queue`` is the ranked pool, where the caller has it.
    """
    check_budgets([budget])
    sampler = Resampler(scored, replicates, seed)
    queue = sampler.ranked(queue)
    widths = run_widths(queue.count(), sampler.fan)
    entries = sampler.cell_entries().unionByName(sampler.queue_entries(queue, widths[0]))
    sums = stage(sampler.weighted_sums(entries), "bootstrap-sums")
    yields = sampler.yields_of(queue, widths, sums, budget)
    long = macro_f1_of(sums).select(F.lit(STATISTICS[0]).alias("statistic"), F.col("macro_f1").alias("value"))
    measures = ("priority_yield", "random_yield", "difference")
    pairs = [F.struct(F.lit(name).alias("statistic"), F.col(m).alias("value")) for name, m in zip(STATISTICS[1:], measures)]
    long = long.unionByName(yields.select(F.inline(F.array(*pairs))))
    bounds = percentile_interval(long, "value", confidence, "statistic")

    reviewed = review_metrics(queue, [budget])
    pool = queue.agg(F.count("*").alias("n"), F.sum("is_error").alias("e"))
    random_point = pool.select(F.try_divide(F.col("e").cast("double"), F.col("n").cast("double")).alias("r"))
    priority = reviewed.select("audit_yield").scalar()
    random = F.when(priority.isNotNull(), random_point.scalar())
    point = C.classification_summary(scored).select("macro_f1").scalar()
    values = (point, priority, random, priority - random)
    status = "computed" if sampler.n_queries >= 2 else "insufficient_query_groups"
    rows = [F.struct(F.lit(name).alias("statistic"), value.alias("point")) for name, value in zip(STATISTICS, values)]
    points = sampler.spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    return (
        points.join(bounds, "statistic", "left")
        .fillna({"n_valid": 0})
        .select("statistic", "point", "low", "high", "n_valid", F.lit(status).alias("status"))
    )
