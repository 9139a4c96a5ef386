"""Exact search for the largest inner products, by block-at-a-time pruning.

A component is a term; its weight may be negative. Rows are ordered so that
neighbours share their leading terms, and cut into blocks of consecutive rows, the
document ranges. A block keeps the rows themselves (its forward index) and the
largest and smallest weight of every term. For a query the summed term maxima of
a block (a negative query weight takes the smallest) bound every score inside.
A query takes blocks in the order of their bounds and stops at the first bound
below its k-th best score; equal bounds are still scored, as ties go by id.

On a cluster this takes two waves. Consecutive blocks form regions, with maxima of
their own, about 1/2000 of the table. Every query first visits the region with
the best bound, which gives it a k-th score; then it visits only the regions whose
bound reaches that score. Visits are dealt to tasks by region and a hash of the
query, so a region that all queries want is many tasks, each with one region and a
bounded number of queries. Only k rows of a query and visit go on.

The result is exact for any data. How much is skipped depends on the data: vectors
in clusters skip most regions, vectors without structure skip few, and then every
query is scored against all rows, in blocks.

Defined results: rows without an id, with a null vector, or with null or
non-finite components take no part; a query is compared with vectors of its own
length only (empty vectors with each other, at 0); rows with equal ids are rows
like others: a query leaves out only its own row, and repeated query rows give
repeated results; a query without candidates gives no rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelens.llm.common import parts, pick
from judgelens.llm.vectors import EXACT, SCALE, complete, matrix, number_type, whole
from judgelens.sources.staging import stage

# Rows of a block, rows of a region at most, numbers of a region aimed at.
BLOCK, REGION, REGION_NUMBERS = 32, 4096, 1 << 18
# Queries and regions that meet in one task for their bounds; queries of one task that scores a region.
PACK, BAND, SLICE = 2048, 1024, 1024
# Leading terms that order the rows.
LEADING = 4

BLOCKS = "width int, region long, place int, rows array<long>, ids array<long>, v array<int>, high array<int>, low array<int>, region_high array<int>, region_low array<int>"
VISITS = "region long, row long, query_id long, width int, q array<int>, bound double, floor long"
FOUND = "row long, query_id long, vec_id long, score long"


def leading_terms(vector: str) -> Column:
    """The terms of the largest absolute weights, with their signs."""
    weights = F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("size"), (i * 2 + (x < 0).cast("int")).alias("term")))
    return F.transform(F.slice(F.array_sort(weights), 1, LEADING), lambda s: s["term"])


def region_rows(width: int, block: int, region: int) -> int:
    """Rows of a region: whole blocks, fewer for long vectors."""
    return max(1, min(region, REGION_NUMBERS // max(width, 1)) // block) * block


def _blocks(block: int, region: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, []

        def cut(size: int) -> Iterator[pa.RecordBatch]:
            """One region of the first ``size`` rows held; the rest stays."""
            nonlocal made, held
            rows = pa.Table.from_batches(held).combine_chunks()
            taken, rest = rows.slice(0, size), rows.slice(size)
            held = rest.to_batches() if rest.num_rows else []
            width = taken["width"][0].as_py()
            m = matrix(taken["v"].combine_chunks(), width)
            ids, keys = taken["vec_id"].to_numpy(), taken["row"].to_numpy()
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            out = []
            for place, at in enumerate(range(0, len(m), block)):
                b = m[at : at + block]
                first = place == 0
                out.append(
                    {
                        "width": width,
                        "region": number,
                        "place": place,
                        "rows": keys[at : at + block],
                        "ids": ids[at : at + block],
                        "v": b.ravel(),
                        "high": b.max(axis=0),
                        "low": b.min(axis=0),
                        "region_high": m.max(axis=0) if first else None,
                        "region_low": m.min(axis=0) if first else None,
                    }
                )
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

        schema = pa.schema(
            [("width", pa.int32()), ("region", pa.int64()), ("place", pa.int32()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))]
            + [(name, pa.list_(pa.int32())) for name in ("v", "high", "low", "region_high", "region_low")]
        )
        for batch in batches:
            widths = batch["width"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and held[0]["width"][0].as_py() != widths[a]:
                    yield from cut(sum(h.num_rows for h in held))
                held.append(batch.slice(a, b - a))
                full = region_rows(int(widths[a]), block, region)
                while sum(h.num_rows for h in held) >= full:
                    yield from cut(full)
        if held:
            yield from cut(sum(h.num_rows for h in held))

    return build


def block_index(rows: DataFrame, block: int = BLOCK, region: int = REGION) -> DataFrame:
    """Blocks of rows that share leading terms, as a staged table; the first block of a region carries the region's maxima."""
    total = rows.count()
    tasks = max(-(-total // (16 * region)), min(-(-total // region), parts(rows.sparkSession)), 1)
    ordered = rows.withColumn("key", leading_terms("v")).repartitionByRange(tasks, "width", "key", "row").sortWithinPartitions("width", "key", "row")
    return stage(ordered.select("row", "vec_id", "width", "v").mapInArrow(_blocks(block, region), BLOCKS), "search-blocks")


def _summed_maxima(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per query and block, a score that none inside exceeds."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _bounds(best: bool):
    def bounds(key: tuple, queries: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        """Regions that queries visit: the best one of this band, or all whose bound reaches the floor but for the one seen."""
        if not len(queries) or not len(regions):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in VISITS.split(", ")})
        q, high, low = (np.array(x.tolist()).reshape(len(x), key[0]) for x in (queries["q"], regions["region_high"], regions["region_low"]))
        kind = number_type(q, np.maximum(np.abs(high), np.abs(low)))
        found = _summed_maxima(q.astype(kind), high.astype(kind), low.astype(kind))
        numbers = regions["region"].to_numpy()
        if best:
            at, to = np.arange(len(q)), found.argmax(axis=1)
        else:
            floor = queries["floor"].to_numpy(dtype=float, na_value=-np.inf)
            at, to = np.nonzero((found >= floor[:, None]) & (numbers[None, :] != queries["seen"].to_numpy()[:, None]))
        out = queries.iloc[at][["row", "query_id", "width", "q", "floor"]].reset_index(drop=True)
        return out.assign(region=numbers[to], bound=found[at, to].astype(float))[[c.split()[0] for c in VISITS.split(", ")]]

    return bounds


def visits(queries: DataFrame, regions: DataFrame, best: bool, pack: int = PACK, band: int = BAND) -> DataFrame:
    """Queries against the maxima of all regions, in blocks: packs of queries meet bands of regions."""

    def shares(df: DataFrame, size: int, name: str) -> DataFrame:
        # One row per vector length.
        return F.broadcast(df.groupBy("width").agg(F.ceil(F.count("*") / size).cast("int").alias(name)))

    packs, bands = shares(queries, pack, "packs"), shares(regions, band, "bands")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(packs, "width").join(bands, "width").withColumn("pack", F.pmod(F.xxhash64("row"), "packs").cast("int")).withColumn("band", each("bands"))
    right = regions.join(packs, "width").join(bands, "width").withColumn("band", F.pmod(F.xxhash64("region"), "bands").cast("int")).withColumn("pack", each("packs"))
    keys = ["width", "pack", "band"]
    return (
        left.select(*keys, "row", "query_id", "q", "floor", "seen")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "region", "region_high", "region_low").groupBy(*keys))
        .applyInPandas(_bounds(best), VISITS)
    )


def search_blocks(q: np.ndarray, own: np.ndarray, floor: np.ndarray, m: np.ndarray, keys: np.ndarray, ids: np.ndarray, block: int, k: int):
    """Block-at-a-time search of one region.

    Gives, for the hits, the position of the query, the id and the score, and per
    query the number of rows scored. ``own`` and ``keys`` are row keys: a query does
    not find its own row. Scores below ``floor`` are of no use to a query.
    """
    kind = number_type(q, m)
    least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    q, m = q.astype(kind), m.astype(kind)
    starts = np.arange(0, len(m), block)
    high, low = np.maximum.reduceat(m, starts), np.minimum.reduceat(m, starts)
    bound = _summed_maxima(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    ranked = np.take_along_axis(bound, order, axis=1)
    scores = np.full((len(q), len(m)), least, dtype=kind)
    scored = np.zeros(len(q), dtype=np.int64)
    where = {key: at for at, key in enumerate(keys.tolist())}
    mine = np.array([where.get(x, -1) for x in own.tolist()], dtype=np.int64)
    # A floor came as a double: where that is not exact, the next smaller one is safe.
    floor = np.where(np.abs(floor) < EXACT, floor, np.nextafter(floor, -np.inf))
    kth = np.array([least if np.isnan(x) else x for x in floor.tolist()], dtype=kind)
    # Runs of 1, 1, 2, 4, ... blocks of each query's order, so that few products make up a full search.
    at, run = 0, 1
    while at < len(starts):
        live = np.flatnonzero(ranked[:, at] >= kth)
        if not len(live):
            break
        until = min(len(starts), at + run)
        wanted = order[live, at:until]
        due = np.take_along_axis(bound[live], wanted, axis=1) >= kth[live][:, None]
        who, which = live[np.nonzero(due)[0]], wanted[due]
        sort = np.argsort(which, kind="stable")
        who, which = who[sort], which[sort]
        for group in np.split(np.arange(len(which)), np.flatnonzero(np.diff(which)) + 1):
            a, some = starts[which[group[0]]], who[group]
            rows = m[a : a + block]
            scores[some, a : a + len(rows)] = q[some] @ rows.T
            scored[some] += len(rows)
        inside = np.flatnonzero(mine >= 0)
        scores[inside, mine[inside]] = least
        if scores.shape[1] >= k:
            kth = np.maximum(kth, np.partition(scores, -k, axis=1)[:, -k])
        at, run = until, max(1, until)
    hit, row = np.nonzero((scores >= kth[:, None]) & (scores > least))
    sort = np.lexsort((ids[row], -scores[hit, row], hit))
    hit, row = hit[sort], row[sort]
    first = np.searchsorted(hit, hit)
    keep = np.arange(len(hit)) - first < k
    hit, row = hit[keep], row[keep]
    return hit, ids[row], scores[hit, row].astype(np.int64), scored


def _score(k: int):
    def score(key: tuple, blocks: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(some):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        blocks = blocks.sort_values("place")
        keys, ids = np.concatenate(blocks["rows"].tolist()), np.concatenate(blocks["ids"].tolist())
        width = int(some["width"].iloc[0])
        m = np.concatenate(blocks["v"].tolist()).reshape(len(ids), width)
        q = np.array(some["q"].tolist()).reshape(len(some), width)
        floor = some["floor"].to_numpy(dtype=float, na_value=np.nan)
        hit, found, scores, _ = search_blocks(q, some["row"].to_numpy(), floor, m, keys, ids, len(blocks["rows"].iloc[0]), k)
        return pd.DataFrame({"row": some["row"].to_numpy()[hit], "query_id": some["query_id"].to_numpy()[hit], "vec_id": found, "score": scores})

    return score


def score_visits(blocks: DataFrame, some: DataFrame, k: int, per_task: int = SLICE) -> DataFrame:
    """At most ``k`` rows of each query and visited region; a task holds one region and about ``per_task`` queries."""
    slices = some.groupBy("region").agg(F.ceil(F.count("*") / per_task).cast("int").alias("slices"))
    left = blocks.join(slices, "region").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = some.join(slices, "region").withColumn("slice", F.pmod(F.xxhash64("row"), "slices").cast("int"))
    return (
        left.select("region", "slice", "place", "rows", "ids", "v")
        .groupBy("region", "slice")
        .cogroup(right.select("region", "slice", "row", "query_id", "width", "q", "floor").groupBy("region", "slice"))
        .applyInPandas(_score(k), FOUND)
    )


def search(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    every: int = 1,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    block: int = BLOCK,
    region: int = REGION,
    pack: int = PACK,
    band: int = BAND,
    per_task: int = SLICE,
) -> DataFrame:
    """Per query and rank: ``query_id, rank, vec_id, score``.

    Queries are the rows of ``queries``, or the rows of ``vectors`` whose id is
    divisible by ``every``; the latter do not find themselves.
    """

    def prepared(df: DataFrame, row: Column, name: str) -> DataFrame:
        rows = pick(df, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
        rows = rows.where(F.col("vec_id").isNotNull() & complete("v"))
        return stage(rows.select(row.alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size("v").alias("width"), whole("v", scale).alias("v")), name)

    rows = prepared(vectors, F.monotonically_increasing_id(), "search-rows")
    # Rows of a query table of their own have negative keys, so they never are their own row.
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else prepared(queries, -1 - F.monotonically_increasing_id(), "search-queries")
    asked = asked.select("row", F.col("vec_id").alias("query_id"), "width", F.col("v").alias("q"))
    blocks = block_index(rows, block, region)
    regions = blocks.where("place = 0").select("width", "region", "region_high", "region_low")

    none = F.lit(None).cast("long")
    first = visits(asked.withColumns({"floor": none, "seen": none}), regions, True, pack, band)
    first = first.groupBy("row").agg(F.max_by(F.struct(*[c for c in first.columns if c != "row"]), F.struct("bound", "region")).alias("best")).select("row", "best.*")
    first = stage(first, "search-first")
    seeds = stage(score_visits(blocks, first, k, per_task), "search-seeds")
    floors = seeds.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    again = first.select("row", "query_id", "width", "q", F.col("region").alias("seen")).join(floors, "row", "left")
    rest = stage(visits(again, regions, False, pack, band), "search-visits")
    found = seeds.unionByName(score_visits(blocks, rest, k, per_task))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
