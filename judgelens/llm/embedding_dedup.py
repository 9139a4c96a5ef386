"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept vector per group.

Equal vectors are one class from the start, however many there are. Class
representatives are unit vectors; k-means on a bounded sample gives the cells. A
vector belongs to the cell of its nearest centroid, and also visits every cell
whose border is so near that a linked vector may lie behind it: vectors x in cell
c and y in cell d lie on two sides of the plane between the centroids, so if both
were further from it than half of the largest distance of linked vectors, they
could not be linked. Comparing members with members and visitors of each cell
thus finds all links, none is left to chance. A pair that meets in both cells is
counted in the first.

Cells are compared in blocks: members and visitors are dealt to blocks by a hash
of their id, and each pair of blocks is a task of its own with bounded rows, so
one crowded cell is many tasks. Vectors travel as packed bytes, in single precision
if that is what the column holds. A task forms the products in single precision,
and again in double precision for the pairs that these leave within their rounding
bound of the limit or above it. It returns, instead of pairs, the number of links of
each vector and a spanning forest of the links. The work inside a cell is quadratic,
as counting links exactly demands; cells keep it apart.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are groups of their own, and so are vectors of a
length no other vector has; vectors whose ids are equal are one vector if they
are equal, else they all stand under that id; rows without an id are left out of
all links and kept; an empty table gives an empty result; other columns, also
labels, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.llm.common import field_type, map_batches, pick
from judgelens.llm.components import components
from judgelens.sources.staging import stage

COSINE = 0.9
# Vectors per cell aimed at, most cells, sampled vectors per cell for k-means, turns, members and visitors per block.
CELL, MAX_CELLS, SAMPLE, TURNS, BLOCK, VISITORS, SEED = 2048, 4096, 64, 12, 4096, 4, 20260926
# Components of the sampled vectors on the driver at most; rows of one matrix product.
SAMPLE_COMPONENTS, ROWS = 1 << 25, 1024
SLACK = 1e-9


def unit(matrix: np.ndarray) -> np.ndarray:
    # Scaled first, so that no square overflows or vanishes.
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def spherical_kmeans(points: np.ndarray, k: int, turns: int = TURNS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell restarts at the worst served point."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), k, replace=False)].astype(np.float64)
    for _ in range(turns):
        sums, best = np.zeros_like(centers), []
        for start in range(0, len(points), ROWS):
            some = points[start : start + ROWS]
            similar = some @ centers.astype(points.dtype).T
            np.add.at(sums, similar.argmax(axis=1), some)
            best.append(similar.max(axis=1))
        norms = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(norms < SLACK)
        if len(empty):
            worst = np.argsort(np.concatenate(best), kind="stable")[: len(empty)]
            sums[empty], norms[empty] = points[worst], 1.0
        centers = sums / norms[:, None]
    return centers


def border_distance(points: np.ndarray, centers: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Distance of each point from the plane between its own centroid and each other one; infinite to its own."""
    similar = points @ centers.T
    gaps = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 0))
    own = similar[np.arange(len(points)), cell]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(gaps[cell] > SLACK, (own[:, None] - similar) / gaps[cell], 0.0)
    out[np.arange(len(points)), cell] = np.inf
    return out


def packed(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows with an id and a direction; ``v`` packs the components of one number type."""
    single = isinstance(field_type(vectors, "v").elementType, T.FloatType)
    known = vectors.where("vec_id IS NOT NULL AND size(v) > 0").select("vec_id", F.col("v").cast(f"array<{'float' if single else 'double'}>").alias("v"))

    def run(batch: pa.RecordBatch) -> pa.Table:
        column = batch.column("v")
        values = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # null becomes nan, -0.0 becomes 0.0
        ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], ends[:-1]])
        bad = np.logical_or.reduceat(~np.isfinite(values), starts)
        good = np.logical_or.reduceat(values != 0, starts) & ~bad
        raw, size = values.tobytes(), values.itemsize
        keep = np.flatnonzero(good)
        rows = [raw[x * size : y * size] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]
        return pa.table({"vec_id": batch.column("vec_id").take(pa.array(keep)), "v": pa.array(rows, pa.binary())})

    return map_batches(known, run, T.StructType([T.StructField("vec_id", field_type(vectors, "vec_id")), T.StructField("v", T.BinaryType())]))


def matrix(packs, number: str) -> np.ndarray:
    """Packed vectors of one length as unit rows in double precision."""
    packs = list(packs)
    return unit(np.frombuffer(b"".join(packs), dtype=number).reshape(len(packs), -1).astype(np.float64))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable vector: ``rep`` (smallest id), ``copies``, ``v``."""
    return vectors.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def _cells(classes: DataFrame, width: int, number: str, per_cell: int, seed: int) -> np.ndarray:
    """Centroids fitted on a bounded sample of the classes of one vector length (in bytes)."""
    own, n = classes.where(F.octet_length("v") == width), width // np.dtype(number).itemsize
    k = int(min(MAX_CELLS, max(1, own.count() // per_cell)))
    if k == 1:
        return np.eye(1, n)
    most = max(k, min(SAMPLE * k, SAMPLE_COMPONENTS // n))
    rows = own.orderBy(F.xxhash64(F.lit(seed), "rep")).limit(most).select("v").toPandas()
    return spherical_kmeans(matrix(rows["v"], number).astype(np.float32), k, seed=seed)


PLACED = "width int, cell int, home boolean, own_cell int, rep long, copies long, visits binary, v binary"


def place(classes: DataFrame, centers: dict[int, np.ndarray], number: str, reach: float) -> DataFrame:
    """Rows of each class in its own cell and in every cell within ``reach`` of its border."""

    def rows(frames):
        for frame in frames:
            for (width, _), group in frame.groupby([frame["v"].map(len), np.arange(len(frame)) // ROWS]):
                own = centers[int(width)]
                points = matrix(group["v"], number)
                cell = (points @ own.T).argmax(axis=1)
                near = border_distance(points, own, cell) <= reach
                visits = [np.flatnonzero(x).astype("<i4") for x in near]
                at = np.concatenate([np.arange(len(points)), np.repeat(np.arange(len(points)), near.sum(axis=1))])
                home = np.arange(len(at)) < len(points)
                yield pd.DataFrame(
                    {
                        "width": np.int32(width),
                        "cell": np.concatenate([cell, *visits]).astype(np.int32),
                        "home": home,
                        "own_cell": cell[at].astype(np.int32),
                        "rep": group["rep"].to_numpy()[at],
                        "copies": group["copies"].to_numpy()[at],
                        "visits": [visits[k].tobytes() if h else b"" for k, h in zip(at.tolist(), home.tolist())],
                        "v": group["v"].to_numpy()[at],
                    }
                )

    return classes.mapInPandas(rows, PLACED)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links that span the components of all the links given."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


FOUND = "a long, b long, n long"


def _compare(cosine: float, number: str):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks: counts (b null) and a spanning forest (n null)."""
        _, cell, i, j, kind = key
        left = rows[rows["side"] == 0].sort_values("rep")
        right = left if kind == "same" else rows[rows["side"] == 1].sort_values("rep")
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        x = matrix(left["v"], number)
        short, width = x.astype(np.float32), x.shape[1]
        # A single-precision product of unit vectors is off by less than (width + 2) units of rounding.
        margin, packs_y = 1e-5 + 1.2e-7 * width, right["v"].to_numpy()
        ids_x, ids_y = left["rep"].to_numpy(), right["rep"].to_numpy()
        copies_x, copies_y = left["copies"].to_numpy(), right["copies"].to_numpy()
        counts_x, counts_y = np.zeros(len(ids_x), np.int64), np.zeros(len(ids_y), np.int64)
        links_a, links_b = [], []
        # Members stand left; a visitor whose own cell is visited by the member too was compared there if that cell comes first.
        visits = left["visits"].to_numpy()
        own = right["own_cell"].to_numpy()
        for start in range(0, len(ids_y), ROWS):
            y = matrix(packs_y[start : start + ROWS], number)
            p, q = np.nonzero(short @ y.astype(np.float32).T >= cosine - margin)
            sure = np.concatenate([np.zeros(0, bool), *((x[p[k : k + ROWS]] * y[q[k : k + ROWS]]).sum(axis=1) >= cosine for k in range(0, len(p), ROWS))])
            p, q = p[sure], q[sure] + start
            if kind == "same":
                p, q = p[p < q], q[p < q]
            elif kind == "visit" and len(p):
                keep = np.array([own[b] > cell or own[b] not in np.frombuffer(visits[a], "<i4") for a, b in zip(p.tolist(), q.tolist())], dtype=bool)
                p, q = p[keep], q[keep]
            np.add.at(counts_x, p, copies_y[q])
            np.add.at(counts_y, q, copies_x[p])
            spanning = forest(ids_x[p], ids_y[q])
            links_a.append(ids_x[p[spanning]])
            links_b.append(ids_y[q[spanning]])
        a, b = np.concatenate(links_a), np.concatenate(links_b)
        spanning = forest(a, b)
        ids, counts = np.concatenate([ids_x, ids_y]), np.concatenate([counts_x, counts_y])
        some = counts > 0
        none = [None] * len(spanning)
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[some], a[spanning]]),
                "b": pd.array([*[None] * int(some.sum()), *b[spanning].tolist()], dtype="Int64"),
                "n": pd.array([*counts[some].tolist(), *none], dtype="Int64"),
            }
        )

    return compare


def deal_blocks(placed: DataFrame, block: int) -> DataFrame:
    """Copy each row to the pairs of blocks it takes part in: ``i, j, kind, side`` are added.

    With m member blocks and w visitor blocks in a cell, member block i meets the
    member blocks j >= i and all visitor blocks, which hold ``VISITORS`` times as many rows.
    """
    sizes = placed.groupBy("width", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("m"), F.ceil(F.sum((~F.col("home")).cast("int")) / (VISITORS * block)).cast("int").alias("w")
    )
    with_sizes = placed.join(sizes, ["width", "cell"]).where("m > 0")
    hashed = F.xxhash64(F.lit(SEED + 1), "rep")
    mine = F.when(F.col("home"), F.pmod(hashed, F.col("m"))).otherwise(F.pmod(hashed, F.greatest("w", F.lit(1)))).cast("int")

    def seat(i, j, kind, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), F.lit(side).alias("side"))

    b, m, w = F.col("mine"), F.col("m"), F.col("w")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    members = F.concat(
        F.array(seat(b, b, "same", 0)),
        F.transform(F.filter(up_to(m), lambda j: j > b), lambda j: seat(b, j, "cross", 0)),
        F.transform(F.filter(up_to(m), lambda i: i < b), lambda i: seat(i, b, "cross", 1)),
        F.transform(up_to(w), lambda j: seat(b, j, "visit", 0)),
    )
    visitors = F.transform(up_to(m), lambda i: seat(i, b, "visit", 1))
    seats = F.explode(F.when(F.col("home"), members).otherwise(visitors)).alias("seat")
    dealt = with_sizes.withColumn("mine", mine).select("width", "cell", "rep", "copies", "own_cell", "visits", "v", seats)
    return dealt.select("width", "cell", "seat.*", "rep", "copies", "own_cell", "visits", "v")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, per_cell: int = CELL, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``; for a ``cosine`` above 0."""
    rows = pick(vectors, vec_id=id_col, v=vector_col)
    number = "<f4" if isinstance(field_type(rows, "v").elementType, T.FloatType) else "<f8"
    good = stage(packed(rows).distinct(), "vectors")
    classes = stage(vector_classes(good), "vector-classes")
    # Lengths (in bytes) are few; each has its own cells.
    widths = [r[0] for r in classes.select(F.octet_length("v")).distinct().collect()]
    centers = {width: _cells(classes, width, number, per_cell, seed) for width in widths}
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + SLACK)
    placed = stage(place(classes, centers, number, reach), "vector-cells")  # read twice
    dealt = deal_blocks(placed, block)
    found = stage(dealt.groupBy("width", "cell", "i", "j", "kind").applyInPandas(_compare(cosine, number), FOUND), "vector-links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("other"))
    groups = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")
    of_class = (
        classes.join(counts, "rep", "left")
        .join(groups, "rep", "left")
        .select("v", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    of_vector = stage(good.join(of_class, "v").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vector-groups")
    out = rows.select("vec_id").join(of_vector, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
