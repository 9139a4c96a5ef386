"""Mix sources to target weights by cube-method balanced sampling.

Every source gets a target in words: its share by weight of ``total_share`` of
all words, at most ``most`` times what it has; what is cut off goes to the other
sources by weight until none is above. A document of a source with ratio
f = target / size is taken floor(f) times for sure and once more with
probability f - floor(f). Those extra copies are drawn by the cube method: the
vector of probabilities walks through the null space of the balancing rows
(words, documents) until nearly all entries are 0 or 1, so that the drawn words
and the drawn number of documents of each source stay at their expectation.

The documents of a source are numbered in the order of a seeded hash of id and
text, and the walk runs in blocks of ``block`` numbers, so one huge source is many
tasks of bounded size, also if all its documents share one id or have none. A block
leaves at most two undecided documents; those of the next ``block / 4`` blocks meet
again, and so on until one block is left, whose last few documents (the landing) are
rounded to the words nearest to the expected ones, one decided document helping out.

Defined results: a null text has 0 words, a null source is a source of its own
that sorts last, a null document id is hashed as such, repeated rows are separate
documents (of equal ones any may be the one that is taken), an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import keyed_rows, pick, word_count
from judgelens.operators.numbering import number_rows
from judgelens.sources.staging import stage

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MOST, BLOCK, SEED = 1.5, 2.0, 2048, 20260926
EDGE = 1e-9


def walk(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Flight phase: move the chances along null vectors of (size, 1) until at most three are open."""
    chances, window, ahead = list(chances), [], iter(range(len(sizes)))
    while True:
        while len(window) < 3 and (k := next(ahead, None)) is not None:
            if EDGE < chances[k] < 1 - EDGE:
                window.append(k)
            else:
                chances[k] = float(round(chances[k]))
        if len(window) < 2:
            return chances
        if len(window) == 3:
            a, b, c = (sizes[k] for k in window)
            move = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        elif sizes[window[0]] == sizes[window[1]]:
            move = (1.0, -1.0)
        else:
            return chances
        ups, downs = [], []
        for k, u in zip(window, move):
            if u:
                ups.append(((1 - chances[k]) if u > 0 else chances[k]) / abs(u))
                downs.append((chances[k] if u > 0 else (1 - chances[k])) / abs(u))
        up, down = min(ups), min(downs)
        step = up if rng.random() * (up + down) < down else -down
        for k, u in zip(window, move):
            chances[k] += step * u
            if not EDGE < chances[k] < 1 - EDGE:
                chances[k] = float(round(chances[k]))
        window = [k for k in window if 0.0 < chances[k] < 1.0]


def land(sizes: list[float], chances: list[float]) -> list[float]:
    """Landing phase: the rounding of the open chances nearest to the expected words.

    A few open documents may all be long, so one decided document of the block may
    change sides to take up what their rounding leaves over or short.
    """
    open_ = [k for k, p in enumerate(chances) if 0.0 < p < 1.0]
    goal = sum(sizes[k] * chances[k] for k in open_)
    by_side = {side: sorted((sizes[k], k) for k, p in enumerate(chances) if p == side) for side in (0.0, 1.0)}
    best = None
    for bits in itertools.product((0.0, 1.0), repeat=len(open_)):
        over = sum(sizes[k] * b for k, b in zip(open_, bits)) - goal
        options = [(abs(over), 0, bits, None)]
        side = by_side[1.0 if over > 0 else 0.0]
        near = bisect.bisect_left(side, (abs(over), -1))
        options += [(abs(abs(over) - size), 1, bits, k) for size, k in side[max(0, near - 1) : near + 1]]
        best = min([best, *options] if best else options, key=lambda x: x[:3])
    out = list(chances)
    for k, bit in zip(open_, best[2]):
        out[k] = bit
    if best[3] is not None:
        out[best[3]] = 1.0 - out[best[3]]
    return out


def _fly(seed: int, level: int):
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        rng = random.Random(f"{seed}:{level}:{key[0]}:{key[1]}")
        sizes = rows["size"].astype(float).tolist()
        chances = walk(sizes, rows["chance"].tolist(), rng)
        if rows["last"].iloc[0]:
            chances = land(sizes, chances)
        return rows.assign(chance=chances)

    return fly


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source, source_no, n_docs, source_size, target``.

    ``sizes`` has source and size. Sources are numbered by a distributed sort, as
    their number may grow with the data. Each turn of the loop reads two sums from
    the staged source table and marks the sources that reach their cap; it ends
    when no new one does.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    numbered = number_rows(sums, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    staged = stage(numbered.withColumn("weight", weight), "mix-sources")
    total = staged.agg(F.sum("source_size")).first()[0] or 0
    cap, unit, ceiling = F.lit(most) * F.col("source_size"), 0.0, -1.0
    # A source is capped once the words per weight reach its own cap per weight; the level only rises.
    while unit > ceiling:
        full = cap <= F.lit(unit) * F.col("weight")
        got = staged.agg(
            F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.sum(F.when(~full, 1)).alias("open")
        ).first()
        ceiling = unit
        if got["open"]:
            unit = max(unit, (total_share * total - (got["capped"] or 0.0)) / got["weight"])
    return staged.withColumn("target", F.least(cap, F.lit(unit) * F.col("weight")).cast("double")).drop("weight")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: float = MOST,
    block: int = BLOCK,
    seed: int = SEED,
    key_col: str | None = None,
) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken``, and ``key`` if a key of the rows is named."""
    sized = pick(docs, doc_id=id_col, text=text_col, source=source_col, key=key_col or id_col).select(
        "doc_id", "key", "source", word_count("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order")
    )
    sized = stage(sized, "mix-sizes")
    targets = source_targets(sized, weights, total_share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .select(
            "doc_id",
            "key",
            sized["source"],
            "size",
            "source_no",
            "n_docs",
            "source_size",
            "target",
            F.floor(ratio).alias("sure"),
            (ratio - F.floor(ratio)).alias("chance"),
            "order",
        )
    )
    # A ratio of almost a whole number is that number.
    near = F.col("chance") > 1 - EDGE
    rows = rows.withColumns({"sure": F.when(near, F.col("sure") + 1).otherwise(F.col("sure")), "chance": F.when(near | (F.col("chance") < EDGE), F.lit(0.0)).otherwise(F.col("chance"))})
    rows = number_rows(rows, ["source_no", "order", F.col("doc_id").asc_nulls_last(), "size", F.col("key").asc_nulls_last()], "number").drop("order")
    begins = rows.groupBy("source_no").agg(F.min("number").alias("begin"))
    rows = rows.join(begins, "source_no").withColumn("number", F.col("number") - F.col("begin")).drop("begin")
    # All open documents of a source have one chance, so its first blocks are full.
    done, span = [], block
    while True:
        rows = stage(rows, "mix-chances")
        done.append(rows.where(~F.col("chance").between(EDGE, 1 - EDGE)))
        rows = rows.where(F.col("chance").between(EDGE, 1 - EDGE))
        if rows.isEmpty():
            break
        columns = rows.columns
        dealt = rows.withColumn("block", F.floor(F.col("number") / span)).withColumn("last", F.col("n_docs") <= span)
        rows = dealt.groupBy("source_no", "block").applyInPandas(_fly(seed, span), dealt.schema).select(*columns)
        span *= max(2, block // 4)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.round("chance")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *["key"] * bool(key_col))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows are drawn each for itself, also with shared or missing ids."""
    rows = keyed_rows(docs, id_col, text_col)
    drawn = mix(rows.select("key", "text", F.col("doc")[id_col].alias("id"), F.col("doc")[source_col].alias("source")), "id", "text", "source", key_col="key", **options)
    taken = drawn.where("copies > 0").select(F.col("key").alias("taken"), F.col("copies").cast("int").alias("copies"))
    taken = stage(taken, "mix-copies")
    # One row per document, so it can't be sent to all: the texts are shuffled once, at any size. At most floor(most) + 1 copies.
    return rows.join(taken.hint("merge"), F.col("key") == F.col("taken")).select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc")).select("doc.*")
