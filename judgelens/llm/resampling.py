"""Importance resampling towards a target: documents that look like the target texts are drawn more often.

Features are runs of words, hashed to buckets. Both sides are counted into arrays
of buckets; the logarithm of the ratio of the smoothed shares is the gain of a bucket,
and a document weighs the mean gain of its features, looked up in the array of
gains. Weight plus seeded Gumbel noise is the score, and the highest scores are a draw
without replacement with chances by weight.

The cutoff is found without sorting all rows, by weighted median-of-medians. Rows
are kept in staged partitions, each sorted by key (score down, id up). In a turn each
partition tells the median of its open keys and how many there are; the median
of these medians, weighted by the open sizes, splits the open keys so that at least a
quarter lies on either side. Counting the keys up to it tells which side holds the
cutoff, and the other side is discarded, until one open key is left: the cutoff, exactly.
A turn reads one row per partition to the driver, and a file only where its range
of scores is still open. Only the winners are sorted, for their ranks.

Memory: two arrays of ``buckets`` numbers and the words met last per task; an open
partition holds 24 bytes a row. One source, word or repeated text of any size is rows
like others; nothing is grouped by them, except the counts of a bucket, which
partitions add up first.

Defined results: a null or empty text has no features and weight 0; repeated rows are
drawn as rows of their own; rows without an id come after others of equal score, with
the noise of an empty id; an empty target gives gains from the smoothing alone; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import as_bytes, pick
from judgelens.operators.numbering import number_rows
from judgelens.sources.staging import stage

BUCKETS, WORDS_IN_RUN, PERCENT, MIN_WORDS, SEED = 10_000, 1, 10, 20, 2024
# Words whose buckets a task remembers before it starts anew.
REMEMBERED = 1 << 19
# Words of a text that are looked up at once.
AT_ONCE = 1 << 20

# Letters a-z (from A-Z too), digits and all bytes beyond ASCII make words; the rest cuts them.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def feature_buckets(text: bytes, known: Buckets, longest: int) -> tuple[int, Iterator[np.ndarray]]:
    """Number of words, and the buckets of all runs of 1 to ``longest`` words in pieces of bounded size."""
    words = text.translate(TO_WORDS).split()

    def pieces():
        for n in range(1, longest + 1):
            runs = len(words) - n + 1
            for at in range(0, runs, AT_ONCE):
                until = min(runs, at + AT_ONCE)
                some = words[at:until] if n == 1 else [b" ".join(words[i : i + n]) for i in range(at, until)]
                yield np.fromiter(map(known.__getitem__, some), dtype=np.int64, count=until - at)

    return len(words), pieces()


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = WORDS_IN_RUN) -> np.ndarray:
    """Features per bucket over all texts; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                for piece in feature_buckets(text, known, longest)[1]:
                    total += np.bincount(piece, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    sums = pick(texts, text=text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in sums.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share, rounded down."""
    k = len(corpus)
    s_all, t_all = int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in pairs], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Thousandths of the Gumbel noise of a document, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def score_documents(docs: DataFrame, gains: np.ndarray, longest: int = WORDS_IN_RUN, seed: int = SEED) -> DataFrame:
    """Per row of ``doc_id, text``: features, weight and score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gains))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                n_words, pieces = feature_buckets(text, known, longest)
                n = total = 0
                for piece in pieces:
                    n += len(piece)
                    total += int(gains[piece].sum())
                weight = total // n if n else 0
                rows.append((doc_id, n_words, n, weight, weight + gumbel(doc_id, seed)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(score, SCORED)


# Order of keys: higher score, smaller id, place; a missing id comes last.
LAST_ID = (1 << 63) - 1


def with_key(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"k1": -F.col("score"), "k2": F.coalesce("doc_id", F.lit(LAST_ID)), "k3": F.monotonically_increasing_id()})


def up_to(key: tuple) -> Column:
    """Whether a row's key is at most this one."""
    a, b, c = (F.lit(int(x)) for x in key)
    return (F.col("k1") < a) | ((F.col("k1") == a) & ((F.col("k2") < b) | ((F.col("k2") == b) & (F.col("k3") <= c))))


def _at_most(columns: list[np.ndarray], key: tuple) -> np.ndarray:
    a, b, c = columns
    return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))


def _median(columns: list[np.ndarray]) -> tuple | None:
    """Lower median of the keys."""
    if not len(columns[0]):
        return None
    at = np.lexsort(columns[::-1])[(len(columns[0]) - 1) // 2]
    return tuple(int(c[at]) for c in columns)


SIDES = "side int, n long, k1 long, k2 long, k3 long"


def _split(low: tuple | None, high: tuple | None, pivot: tuple | None):
    """Per partition, the open keys up to the pivot (side 0) and beyond it (side 1): how many, and their median."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            open_ = np.ones(batch.num_rows, dtype=bool)
            if high is not None:
                open_ &= _at_most(columns, high)
            if low is not None:
                open_ &= ~_at_most(columns, low)
            for kept, c in zip(held, columns):
                kept.append(c[open_])
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in held]
        first = np.zeros(len(columns[0]), bool) if pivot is None else _at_most(columns, pivot)
        for side, mask in ((0, first), (1, ~first)):
            some = [c[mask] for c in columns]
            if len(some[0]):
                yield pa.RecordBatch.from_pylist([dict(zip(("side", "n", "k1", "k2", "k3"), (side, len(some[0]), *_median(some))))], schema=schema)

    schema = pa.schema([("side", pa.int32()), *[(name, pa.int64()) for name in ("n", "k1", "k2", "k3")]])
    return split


def weighted_median(medians: list[tuple[int, tuple]]) -> tuple:
    """The smallest key such that at least half of the weight lies at or before it."""
    total, seen = sum(n for n, _ in medians), 0
    for n, key in sorted(medians, key=lambda x: x[1]):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no keys")


def cutoff_key(keys: DataFrame, wanted: int, log: list | None = None) -> tuple | None:
    """The key of rank ``wanted`` among rows with columns ``k1, k2, k3``, which must be distinct; null beyond either end.

    ``log`` takes the number of open keys of each turn.
    """
    keys = keys.select("k1", "k2", "k3")
    low = high = pivot = None
    medians: list[tuple[int, tuple]] = []
    if wanted < 1:
        return None
    while True:
        # The range of scores is pushed down to the files; the exact test of the key follows in the task.
        some = keys
        if low is not None:
            some = some.where(F.col("k1") >= low[0])
        if high is not None:
            some = some.where(F.col("k1") <= high[0])
        rows = some.mapInArrow(_split(low, high, pivot), SIDES).collect()  # at most two rows per partition
        sides: list[list[tuple[int, tuple]]] = [[], []]
        for side, n, *key in rows:
            sides[side].append((n, tuple(key)))
        before = sum(n for n, _ in sides[0])
        if pivot is None or wanted > before:
            medians, wanted, low = sides[1], wanted - before, pivot
        else:
            medians, high = sides[0], pivot
        left = sum(n for n, _ in medians)
        if log is not None:
            log.append(left)
        if wanted > left:
            return None
        if left == 1:
            return medians[0][1]
        pivot = weighted_median(medians)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = WORDS_IN_RUN,
    seed: int = SEED,
) -> DataFrame:
    """Per document: ``doc_id, n_features, weight, score, rank, n_words``; the rank is null for those not drawn.

    Drawn are the highest ``percent`` of a hundred of the documents with at least ``min_words`` words.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Keys are written once: the place in the table breaks the last ties, and must stay the same. Sorted files can be passed over by score.
    scored = stage(with_key(score_documents(texts, gains, longest, seed)).sortWithinPartitions("k1", "k2", "k3"), "resampling-scores")
    able = scored.where(F.col("n_words") >= min_words)
    cutoff = cutoff_key(able, able.count() * percent // 100)
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    none = F.lit(None).cast("long")
    if cutoff is None:
        return scored.withColumn("rank", none).select(*columns)
    chosen = (F.col("n_words") >= min_words) & up_to(cutoff)
    winners = number_rows(scored.where(chosen), ["k1", "k2", "k3"], "rank")
    return winners.select(*columns).unionByName(scored.where(~chosen).withColumn("rank", none).select(*columns))
