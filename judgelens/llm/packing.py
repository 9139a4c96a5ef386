"""Best-fit-decreasing packing of token sequences.

Documents of at most ``capacity`` tokens stay whole; longer ones are cut into
pieces of ``capacity``, the first piece being the shorter one. Pieces then go,
longest first, each into the open bin it fits tightest.

Which bin a piece gets depends on its length only, so the global packing is
worked out on the histogram of lengths (at most ``capacity`` numbers, whatever
the input): bins with the same free space form runs, a segment tree over the
free space finds the tightest run for a length in logarithmic time, and a whole
run of bins takes a whole run of equal pieces at once. The result is a table of
steps "pieces a..b of length l go to bins x..y, q in each, at offset o". A step
either uses up a run or ends its length, so there are at most about 1.5 *
capacity^2 steps and far fewer in practice. Pieces are numbered within their
length from per-task counts, and a task looks its pieces up in the steps.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.llm.common import field_type, map_batches, pick, tokenizer_file
from judgelens.llm.tokens import encode_column
from judgelens.sources.staging import stage

CAPACITY = 1024


class FreeSpace:
    """Segment tree over the free space of open bins: which sizes occur, smallest at least x first."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.used = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, free: int, value: int) -> None:
        k = free + self.size
        while k:
            self.used[k] += value
            k //= 2

    def add(self, free: int, first_bin: int, n_bins: int) -> None:
        if free and n_bins:
            self.runs[free].append((first_bin, n_bins))
            self._mark(free, 1)

    def tightest(self, length: int) -> int | None:
        """The smallest free space of at least ``length`` that some bin has."""
        k = length + self.size
        if self.used[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.used[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.used[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None

    def take(self, free: int) -> tuple[int, int]:
        self._mark(free, -1)
        return self.runs[free].pop()


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first piece, pieces, first bin, pieces per bin, offset) of best fit decreasing."""
    space, steps, bins = FreeSpace(capacity), [], 0
    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            free = space.tightest(length)
            if free is None:
                free = capacity
                first, n_bins = bins, -(-left // (capacity // length))
                bins += n_bins
            else:
                first, n_bins = space.take(free)
            each = free // length
            full = min(n_bins, left // each)
            rest = min(left - full * each, each) if full < n_bins else 0
            if full:
                steps.append((length, placed, full * each, first, each, capacity - free))
                space.add(free - each * length, first, full)
            if rest:
                steps.append((length, placed + full * each, rest, first + full, rest, capacity - free))
                space.add(free - rest * length, first + full, 1)
            space.add(free, first + full + bool(rest), n_bins - full - bool(rest))
            placed, left = placed + full * each + rest, left - full * each - rest
    return steps


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n > 0 tokens."""
    head = n % capacity or capacity
    return [(0, head), *((start, capacity) for start in range(head, n, capacity))]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """Cut the token ids of each text: ``doc_id, piece, start, length, ids_crc32[, ids]``."""
    path = tokenizer_file(vocabulary)
    schema = T.StructType(
        [
            T.StructField("doc_id", field_type(docs, id_col)),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )

    def pieces(batch: pa.RecordBatch) -> pa.Table:
        row, piece, starts, lengths, sums, raws = [], [], [], [], [], []
        for first, ids, ends in encode_column(batch.column("text"), path):
            begin = 0
            for k, end in enumerate(ends.tolist(), first):
                for number, (start, length) in enumerate(cut(end - begin, capacity)):
                    raw = ids[begin + start : begin + start + length].tobytes()
                    row.append(k)
                    piece.append(number)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(raw))
                    if with_ids:
                        raws.append(raw)
                begin = end
        return pa.table(
            {
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
            | ({"ids": pa.array(raws, pa.binary())} if with_ids else {})
        )

    return map_batches(pick(docs, doc_id=id_col, text=text_col), pieces, schema)


def assign_bins(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` between 1 and ``capacity``."""
    columns = pieces.columns
    # The place of a row is stored, so the numbers below stay the same for every later read.
    placed = stage(pieces.withColumn("_place", F.monotonically_increasing_id()), "pack-pieces")
    part = F.shiftright("_place", 33)
    sizes = stage(placed.groupBy("length", part.alias("_part")).agg(F.count("*").alias("n")), "pack-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = pack_histogram(counts, capacity)
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("length", "_part").orderBy("_place")
    ranked = (
        placed.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_part"])
        .select(*[F.col(f"`{c}`") for c in columns], (F.col("_ahead") + F.col("_rank")).alias("_rank"))
    )
    table = {length: np.array([s[1:] for s in steps if s[0] == length], dtype=np.int64) for length in counts}

    def place(batch: pa.RecordBatch) -> pa.Table:
        lengths = batch.column("length").to_numpy()
        ranks = batch.column("_rank").to_numpy()
        bins, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            mine = table[int(length)]
            step = mine[np.searchsorted(mine[:, 0], ranks[at], side="right") - 1]
            index = ranks[at] - step[:, 0]
            bins[at] = step[:, 2] + index // step[:, 3]
            offset[at] = step[:, 4] + index % step[:, 3] * length
        kept = pa.Table.from_batches([batch]).select(columns)
        return kept.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offset))

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_batches(ranked, place, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``."""
    return assign_bins(token_pieces(docs, id_col, text_col, capacity, vocabulary, with_ids), capacity)
