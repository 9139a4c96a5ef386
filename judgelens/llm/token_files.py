"""Token ids in Simple-8b blocks.

A block holds the ids of consecutive documents: the top four bits of a 64-bit
word select how many values of how many bits follow in its other 60; runs of
zeros need no bits. A value of more than 60 bits is an escape: selector 15, with
the value itself in the next word. Each block has the document ids, the end
offset of each document and the offset of each ``STRIDE``-th word, so a reader
decodes whole arrays at once and may start inside a block.

A token table is a folder of Parquet files in ascending document order; a row is
a block (``part, block, first, n_ids, doc_ids, ends, marks, words``). Spark writes it wherever
a cluster can write, and a reader needs the rows of a block only.

Defined results: a null text is an empty one and has the end id alone; rows with
equal document ids follow each other, ordered by a hash of the text; null ids come first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.llm.common import field_type, parts, pick, tokenizer_file
from judgelens.llm.tokens import encode_column
from judgelens.sources.staging import new_path

# Fixed values of the Simple-8b coding: values per word by selector, and bits of a value.
VALUES = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
# Selector 15 packs one value of 60 bits; with the lowest of these bits patterns it announces a raw word.
ESCAPE = np.uint64(0xFFFFFFFFFFFFFFFF)
WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)  # bits of small values
BLOCK_IDS, STRIDE = 1 << 16, 128
# Parts of ascending ids that a task of the write holds, and ids sampled for the bounds of each.
PARTS_PER_TASK, SAMPLE_PER_PART, SAMPLE_SEED = 4, 50, 20260926
ROOM = (1 << 60) - 1
ID_TYPES = {False: "<u2", True: "<u4"}  # of shuffled ids


def encode_words(values: np.ndarray) -> np.ndarray:
    """Pack unsigned 64-bit values into Simple-8b words, each word as full as it can be."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    raw = values >= ROOM  # the largest 60-bit value is left for the escape
    if values.max() < len(WIDTHS):
        width = WIDTHS[values]
    else:
        width = np.frexp(values.astype(np.float64))[1].astype(np.int8)  # bits of each value
        width[values >> np.uint64(53) > 0] = 61  # no selector but the last takes such values
    # selector[k]: the one that packs most values from k on; its window must not leave the block or hold a wider value.
    selector = np.full(n, 15, dtype=np.int8)
    narrowest = width.min()
    for s in range(14, -1, -1):
        size = VALUES[s]
        if BITS[s] < narrowest or size > n:
            continue
        # fits[k]: the values from k on, as many as ``span``, are narrow enough; spans double up to the size.
        fits, span = width <= BITS[s], 1
        while span < size:
            step = min(span, size - span)
            fits = fits[:-step] & fits[step:]
            span += step
        np.putmask(selector[: len(fits)], fits, s)
    jump = VALUES.astype(np.uint8)[selector].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 15:
            one = values[starts[mine]]
            words[mine] = np.where(raw[starts[mine]], ESCAPE, words[mine] | one)
            continue
        begin, packed = starts[mine], np.zeros(len(mine), np.uint64)
        for j in range(VALUES[s] if BITS[s] else 0):
            packed |= values[begin + j] << np.uint64(j * BITS[s])
        words[mine] |= packed
    escaped = np.flatnonzero((chosen == 15) & raw[starts])
    return np.insert(words, escaped + 1, values[starts[escaped]]) if len(escaped) else words


def _headers(words: np.ndarray) -> np.ndarray:
    """Which words are coded ones and not the raw value behind an escape."""
    head = np.ones(len(words), bool)
    for k in np.flatnonzero(words == ESCAPE).tolist():
        if head[k]:
            head[k + 1] = False
    return head


def decode_words(words: np.ndarray) -> np.ndarray:
    """The values of a run of words that starts at a coded one."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    where = np.flatnonzero(_headers(words))
    coded = words[where]
    chosen = (coded >> np.uint64(60)).astype(np.int64)
    counts = VALUES[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1], np.uint64)
    starts = ends - counts
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(VALUES[s] if BITS[s] else 0):
            out[starts[mine] + j] = (coded[mine] >> np.uint64(j * BITS[s])) & mask
    escaped = coded == ESCAPE
    out[starts[escaped]] = words[where[escaped] + 1]
    return out


def encode_block(values: np.ndarray) -> tuple[bytes, list[int]]:
    """Words of a block as bytes, and pairs (word offset, value offset) at every ``STRIDE``-th coded word."""
    words = encode_words(values)
    where = np.flatnonzero(_headers(words))
    counts = VALUES[(words[where] >> np.uint64(60)).astype(np.int64)]
    before = np.cumsum(counts) - counts
    marks = np.stack([where[::STRIDE], before[::STRIDE]], axis=1).ravel()
    return words.astype("<u8").tobytes(), marks.tolist()


def decode_block(raw: bytes) -> np.ndarray:
    return decode_words(np.frombuffer(raw, "<u8"))


def decode_range(raw: bytes, marks: list[int], start: int, end: int) -> np.ndarray:
    """Values ``start`` to ``end`` of a block, decoding only the words from the nearest marks on."""
    words, marks = np.frombuffer(raw, "<u8"), np.array(marks, np.int64).reshape(-1, 2)
    if start >= end:
        return np.zeros(0, np.uint64)
    first = np.searchsorted(marks[:, 1], start, side="right") - 1
    last = np.searchsorted(marks[:, 1], end, side="left")
    stop = marks[last, 0] if last < len(marks) else len(words)
    return decode_words(words[marks[first, 0] : stop])[start - marks[first, 1] : end - marks[first, 1]]


def _block_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.LongType()),
            T.StructField("first", T.LongType()),  # ids ahead of the block in its part
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("marks", T.ArrayType(T.LongType())),
            T.StructField("words", T.BinaryType()),
        ]
    )


def _rank(doc_id) -> tuple:
    """A sort key of ids: a missing one comes first."""
    return (doc_id is not None, doc_id if doc_id is not None else 0)


def part_bounds(ids: DataFrame, n_parts: int) -> list[tuple]:
    """Ids that cut the table into about ``n_parts`` equal parts, from a random sample of bounded size; a frequent id occurs repeatedly."""
    sampled = ids.orderBy(F.rand(SAMPLE_SEED)).limit(SAMPLE_PER_PART * n_parts).collect()
    ranks = sorted(_rank(r[0]) for r in sampled)
    return [ranks[len(ranks) * k // n_parts] for k in range(1, n_parts)] if ranks else []


def part_of(bounds: list[tuple], doc_id, mixed: int) -> int:
    """The part of a document. Parts ascend with ids; an id that fills several parts is spread over them by the hash ``mixed``."""
    rank = _rank(doc_id)
    low = bisect.bisect_left(bounds, rank)
    return low + (mixed + (1 << 63)) * (bisect.bisect_right(bounds, rank, low) - low + 1) // (1 << 64)


def packed_ids(tokens: np.ndarray, stops: np.ndarray, wide: bool) -> pa.Array:
    """The ids of each text as bytes, from all ids behind each other and the end of each text."""
    kind = np.dtype(ID_TYPES[wide])
    offsets = np.concatenate([[0], stops]) * kind.itemsize
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("the ids of one text exceed what a column of bytes can hold")
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(tokens.astype(kind))])


def write_token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts; a block ends with the document that reaches ``block_ids`` ids.

    Texts are encoded where they are read; only their ids are shuffled, in two bytes each where they fit.
    """
    file, id_type = tokenizer_file(vocabulary), field_type(docs, id_col)
    schema = _block_schema(id_type)
    rows = pick(docs, doc_id=id_col, text=text_col)
    tasks = parts(docs.sparkSession)
    bounds = part_bounds(rows.select("doc_id"), PARTS_PER_TASK * tasks)
    coded_schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("doc_id", id_type),
            T.StructField("mixed", T.LongType()),
            T.StructField("wide", T.BooleanType()),  # ids of 4 bytes, or of 2
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def encode(batches):
        for batch in batches:
            names, hashes = batch.column("doc_id"), batch.column("mixed").to_pylist()
            placed = [part_of(bounds, name, mixed) for name, mixed in zip(names.to_pylist(), hashes)]
            for first, tokens, stops in encode_column(batch.column("text"), file):
                n = len(stops)
                wide = bool(len(tokens)) and int(tokens.max()) >= 1 << 16
                raws = packed_ids(tokens, stops, wide)
                columns = [pa.array(placed[first : first + n], pa.int32()), names.slice(first, n), batch.column("mixed").slice(first, n), pa.array([wide] * n, pa.bool_()), raws]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "mixed", "wide", "ids"])

    coded = rows.withColumn("mixed", F.xxhash64("text")).mapInArrow(encode, coded_schema)
    ordered = coded.repartition(tasks, "part").sortWithinPartitions("part", "doc_id", "mixed")

    def blocks(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part, number, names, ends, values, before, total = None, 0, [], [], [], 0, 0

        def flush():
            raw, marks = encode_block(np.concatenate(values))
            row = {"part": part, "block": number, "first": before, "n_ids": total, "doc_ids": names, "ends": ends, "marks": marks, "words": raw}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for own, name, wide, raw in zip(*(batch.column(n).to_pylist() for n in ("part", "doc_id", "wide", "ids"))):
                if own != part:
                    if names:
                        yield flush()
                    part, number, names, ends, values, before, total = own, 0, [], [], [], 0, 0
                values.append(np.frombuffer(raw, ID_TYPES[wide]))
                total += len(values[-1])
                names.append(name)
                ends.append(total)
                if total >= block_ids:
                    yield flush()
                    names, ends, values, before, total, number = [], [], [], before + total, 0, number + 1
        if names:
            yield flush()

    ordered.mapInArrow(blocks, schema).write.parquet(path)


def read_token_table(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of a token table: ``doc_id, start, n_tokens, ids_crc32[, ids]``."""
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part: bounded by the partitions of the writing job. The blocks stay where they are read.
    ahead = F.broadcast(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    blocks = stored.join(ahead, "part").select((F.col("ahead") + F.col("first")).alias("base"), "doc_ids", "ends", "words")
    id_type = stored.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def documents(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("base", "doc_ids", "ends", "words")]
            for base, names, ends, raw in zip(*columns):
                ids = decode_block(raw).astype("<u4")
                starts_ = [0, *ends[:-1]]
                spans = [ids[a:b] for a, b in zip(starts_, ends)]
                out = {
                    "doc_id": pa.array(names, batch.schema.field("doc_ids").type.value_type),
                    "start": pa.array([base + a for a in starts_], pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(starts_, ends)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                }
                raws = [x.tobytes() for x in spans] if with_ids else []
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(raws, pa.binary())} if with_ids else {}))

    return blocks.mapInArrow(documents, schema)


def token_table(docs: DataFrame, with_ids: bool = True, **options) -> DataFrame:
    """Write a token table to the shared folder of the session and read it back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-table")
    write_token_table(docs, path, **options)
    return read_token_table(spark, path, with_ids)
