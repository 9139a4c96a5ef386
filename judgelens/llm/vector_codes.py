"""Vector code compression: product quantisation with norm-of-sum bounds.

Vectors are cut into equal parts; each part position has a codebook, trained by
rounds of Lloyd's method on whole numbers, and a vector is stored as the indexes of
the nearest entries. From one round to the next most parts keep their entry, and
bounds tell so without looking at the other entries. For each vector and part the
table keeps the index, the distance to the second nearest entry as found at the
last exact scan, and the number (stamp) of the codebook it was found in. All codebooks
stay at hand. In a later round every other entry can have come nearer by no more than
its true displacement between the codebook of the stamp and the present one: one
distance, not the sum of its movements of all rounds between, which is longer
unless it kept its direction. If the own entry is nearer than the second distance
less the largest such displacement, nothing changes; otherwise all entries are
compared exactly. Bounds are rounded down, and ties are always compared exactly, so
the codes are those of plain full scans.

On a cluster each round is one pass over a staged table, with bounds of 13 bytes a
part beside the whole numbers, and one sum per (part, entry), which tasks
add up first. Only the codebooks reach the driver: parts * entries * length of a
part numbers, for any input.

Defined results: rows with a null vector, or with null or non-finite components are
left out; rows without an id are encoded, but never start a codebook; vectors of
another length than that of the smallest id, or of a length that the parts do not
divide, stay without a code (code, error and label_error null); with fewer vectors
than entries codebooks are smaller; rows with equal ids are rows like others (the
codebook starts with the smaller vector); an empty table gives an empty result; other
columns are ignored. Components are held at +-2**24 after scaling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import pick
from judgelens.llm.vectors import EXACT, SCALE, complete, matrix, whole
from judgelens.sources.staging import stage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
# Bounds are roots of whole numbers; this much covers their rounding.
SLACK = 1e-9
# Rows of one step in a task: rows * parts * entries distances at once.
STEP = 4096

STATE = "vec_id long, label string, v array<int>, codes binary, stamps binary, seconds binary, scans int"


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """Per stamp, part and entry: the largest displacement of any other entry from the codebook of the stamp to the last one."""
    out = []
    for old in history:
        moved = np.sqrt(((history[-1] - old).astype(np.float64) ** 2).sum(axis=2))
        if moved.shape[1] == 1:
            out.append(np.zeros_like(moved))
            continue
        ordered = np.sort(moved, axis=1)
        # The largest one, but for the entry that is largest itself.
        out.append(np.where(np.arange(moved.shape[1]) == moved.argmax(axis=1)[:, None], ordered[:, -2:-1], ordered[:, -1:]))
    return np.stack(out)


def assign(points: np.ndarray, codes, stamps, seconds, history: list[np.ndarray], moved: np.ndarray):
    """Codes, stamps, second distances and exact rescans of ``points`` (rows, parts, length of a part) for the last codebook."""
    book, now = history[-1], len(history) - 1
    n, parts, _ = points.shape
    if codes is None:
        due = np.ones((n, parts), dtype=bool)
        codes, stamps, seconds = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.uint8), np.zeros((n, parts))
    else:
        at = np.arange(parts)
        own = np.sqrt(own_distances(points, codes, book).astype(np.float64))
        bound = seconds - moved[stamps, at, codes]
        due = own * (1 + SLACK) + SLACK >= bound * (1 - SLACK)
    for p in range(parts):
        rows = np.flatnonzero(due[:, p])
        if not len(rows):
            continue
        away = squared_distances(points[rows, p], book[p])
        codes[rows, p] = away.argmin(axis=1)
        stamps[rows, p] = now
        seconds[rows, p] = np.sqrt(np.partition(away, 1, axis=1)[:, 1].astype(np.float64)) if away.shape[1] > 1 else np.inf
    return codes, stamps, seconds, due.sum(axis=1)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of c, exact: in doubles where their digits reach, else in 64 bits."""
    reach = x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) ** 2
    kind = np.float64 if 4 * reach < EXACT else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def own_distances(points: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the parts from their entries."""
    gap = points.astype(np.int64) - book[np.arange(points.shape[1]), codes]
    return (gap * gap).sum(axis=2)


def _steps(batches: Iterator[pa.RecordBatch], parts: int, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            some = batch.slice(at, STEP)
            yield some, matrix(some["v"], width).reshape(some.num_rows, parts, width // parts)


def _stored(column: pa.Array, kind, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), parts).copy()


def assign_all(state: DataFrame, history: list[np.ndarray], first: bool) -> DataFrame:
    """The state of all rows after an assignment to the last codebook."""
    parts, width = history[-1].shape[0], history[-1].shape[0] * history[-1].shape[2]
    moved = displacements(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, points in _steps(batches, parts, width):
            held = (None, None, None) if first else (_stored(some["codes"], np.uint8, parts), _stored(some["stamps"], np.uint8, parts), _stored(some["seconds"], np.float64, parts))
            codes, stamps, seconds, scans = assign(points, *held, history, moved)
            blobs = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (codes, stamps, seconds)]
            yield pa.RecordBatch.from_arrays([some["vec_id"], some["label"], some["v"], *blobs, pa.array(scans, pa.int32())], names=[c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def next_book(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry as the mean of its parts, rounded down; unused entries stay."""
    parts, entries, length = book.shape
    width = parts * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
        for some, points in _steps(batches, parts, width):
            at = (_stored(some["codes"], np.uint8, parts).astype(np.int64) + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, points.reshape(-1, length).astype(np.int64))
            counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "entry": np.repeat(used, length + 1),
                "place": np.tile(np.arange(length + 1), len(used)),
                "total": np.concatenate([sums[used], counts[used][:, None]], axis=1).ravel(),
            }
        )

    totals = state.mapInArrow(run, "entry long, place long, total long").groupBy("entry", "place").agg(F.sum("total").alias("total"))
    table = np.zeros((parts * entries, length + 1), np.int64)
    for entry, place, total in totals.collect():  # at most parts * entries * (length + 1) rows
        table[entry, place] = total
    out, used = book.reshape(-1, length).copy(), table[:, -1] > 0
    out[used] = table[used, :-1] // table[used, -1:]
    return out.reshape(book.shape)


def books_digest(book: np.ndarray) -> str:
    """sha256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def first_book(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids; null if they cannot be cut into equal parts."""
    head = rows.where("vec_id is not null").orderBy("vec_id", "v").select("v")
    one = head.limit(1).collect()
    width = len(one[0][0]) if one else 0
    if not width or width % parts:
        return None
    start = head.where(F.size("v") == width).limit(entries).collect()  # at most ``entries`` vectors
    return np.array([r[0] for r in start], dtype=np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """State of the rows after the last assignment, and the codebooks of all rounds; no codebook if there is nothing to cut."""
    if not 1 <= entries <= 256 or not 0 <= rounds < 256:
        raise ValueError("at most 256 entries and 255 rounds, as an index and a stamp are a byte each")
    book = first_book(rows, parts, entries)
    if book is None:
        return rows, []
    history = [book]
    state = stage(assign_all(rows.where(F.size("v") == parts * book.shape[2]).select("vec_id", "label", "v"), history, True), "codes-0")
    for turn in range(1, rounds + 1):
        history.append(next_book(state, history[-1]))
        state = stage(assign_all(state, history, False), f"codes-{turn}")
    return state, history


CODED = "vec_id long, label string, code string, error long"


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """Per vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    rows = pick(vectors, vec_id=id_col, label=label_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>")).where(complete("v"))
    rows = stage(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole("v", scale).alias("v")), "codes-rows")
    state, history = train(rows, parts, entries, rounds)
    without = rows.select("vec_id", "v", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    digest = F.lit(books_digest(history[-1] if history else np.zeros(0, np.int64))).alias("codebooks_sha256")
    if not history:
        return without.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), digest)
    book = history[-1]
    width = parts * book.shape[2]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, points in _steps(batches, parts, width):
            codes = _stored(some["codes"], np.uint8, parts)
            error = own_distances(points, codes, book).sum(axis=1)
            columns = [some["vec_id"], some["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CODED.split(", ")])

    coded = stage(state.mapInArrow(encode, CODED), "codes-final")  # read twice
    every = coded.unionByName(without.where(F.size("v") != width).drop("v"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = every.join(by_label.withColumnRenamed("label", "own"), F.col("label").eqNullSafe(F.col("own")), "left")
    label_error = F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error")
    return out.select("vec_id", "code", "error", label_error, digest)
