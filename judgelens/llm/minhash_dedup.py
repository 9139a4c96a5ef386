"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles, and a sketch stands for the set: one byte of
each of ``SKETCH`` minwise tokens, and the first ``TREES`` tokens whole. Documents with
equal sets are one class from the start. In each of ``TREES`` independent trees a
class first branches by one minwise token. Two sets of similarity s meet in a branch
with probability s, so at 0.8 a pair misses all ten first branches once in ten
million times.

Families come first: every member of a node is held against its smallest member,
the pivot, by sketch. In a node where several families still meet, the members outside
its largest family are the outsiders. With at most ``LEAF`` outsiders the node is a
leaf: each outsider is compared with all members of other families, which costs a
bounded multiple of the members, however large the largest family is. With more, each
outsider first meets one block of the largest family, which takes in most of what
belongs to it at a cost in proportion to the members. A node that still is large
then branches again, by one token that its own hash chooses or, every other time, by
two. A pair at 0.8 then goes on in 1.2 branches on average and outlives any number of
levels in half of the trees, so ten trees miss it once in a thousand times at worst;
pairs below two thirds die out. Nodes that stay large at the last level are compared
in blocks. A node tells which families agree, not which members. Pairs whose sketches
agree in fewer than ``LEAST_AGREEING`` tokens are passed over; a pair of similarity 0.8
falls below that less than once in 20,000 times, and mostly has other links into its
family.

Full sets, computed from the whole texts of family members only, then decide. Each
member is confirmed against its best pivot, which joins most of a large family at a
cost of one comparison per row. What is left in more than one group is compared
exhaustively inside the family: blocks of at most about ``BLOCK`` sets meet in a task
that counts common shingles by matrix products and returns a spanning forest of the
links, never pairs; two blocks of one and the same group do not meet.

Defined results: a null or empty text, or one without words, has no shingles and
links with nothing; shorter texts than a shingle are one shingle; rows with equal
texts are copies, also under one id; in ``near_duplicates`` rows of one id are one
document, and a row without an id belongs to the group of its text, but to no
near copies; ``distinct_documents`` goes by rows; an empty table gives an empty
result; other columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.llm.common import as_bytes, field_type, keyed_rows, map_batches, pick
from judgelens.llm.components import components
from judgelens.sources.staging import stage

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SKETCH, TREES, DEPTH, LEAF, PORTION, BLOCK = 64, 10, 6, 1024, 256, 1024
COLUMNS = 8192  # shingles of one matrix product
LEAST_AGREEING = 37
MEMO = 100_000
_ODD = np.random.default_rng(20260926)
TOKEN_FACTORS = _ODD.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_FACTORS = _ODD.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of the words met so far; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()


def shingle_set(raw: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; lower case for A-Z, words cut at ASCII white space."""
    words = raw.lower().split()  # bytes.lower changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(WORDS.__getitem__, words)), dtype=np.uint64)
    size_here = min(size, len(words))
    out = np.zeros(len(words) - size_here + 1, np.uint64)
    for k in range(size_here):
        out += hashes[k : k + len(out)] * PLACE_FACTORS[k]
    return np.unique(mix(out + np.uint64(size_here if size_here < size else 0)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Minwise tokens (32 bits each) of a set that is not empty."""
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(hashes), 512):
        tokens = hashes[start : start + 512] * TOKEN_FACTORS[:, None]
        np.minimum(least, (tokens >> np.uint64(32)).astype(np.uint32).min(axis=1), out=least)
    return least.view(np.int32)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: ``doc_id, n_shingles, f1, f2, first, marks``; f1 and f2 are sums that tell sets apart, marks has one byte a token."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        sizes, ones, twos, first, marks = [], [], [], [], []
        for raw in as_bytes(batch.column("text")):
            hashes = shingle_set(raw, words)
            sizes.append(len(hashes))
            ones.append(hashes.sum(dtype=np.uint64).astype(np.int64))
            twos.append(mix(hashes).sum(dtype=np.uint64).astype(np.int64))
            tokens = sketch(hashes) if len(hashes) else None
            first.append(None if tokens is None else tokens[:TREES])
            marks.append(None if tokens is None else tokens.astype(np.uint8).tobytes())
        longs = {n: pa.array(v, pa.int64()) for n, v in (("n_shingles", sizes), ("f1", ones), ("f2", twos))}
        return pa.table({"doc_id": batch.column("doc_id")} | longs | {"first": pa.array(first, pa.list_(pa.int32())), "marks": pa.array(marks, pa.binary())})

    fields = [T.StructField("doc_id", field_type(docs, id_col)), *(T.StructField(n, T.LongType()) for n in ("n_shingles", "f1", "f2"))]
    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, T.StructType([*fields, T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("marks", T.BinaryType())]))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def agreeing_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (low, high) whose sketches agree often enough, with ``agree``."""
    marks = classes.select("rep", "marks")
    both = (
        pairs.join(marks.withColumnsRenamed({"rep": "low", "marks": "s_low"}), "low")
        .join(marks.withColumnsRenamed({"rep": "high", "marks": "s_high"}), "high")
        .select("low", "high", "s_low", "s_high")
    )

    def run(batch: pa.RecordBatch) -> pa.Table:
        agree = (_matrix(batch.column("s_low")) == _matrix(batch.column("s_high"))).sum(axis=1)
        out = pa.table({"low": batch.column("low"), "high": batch.column("high"), "agree": pa.array(agree, pa.int32())})
        return out.filter(pa.array(agree >= LEAST_AGREEING))

    id_type = field_type(classes, "rep")
    schema = T.StructType([T.StructField("low", id_type), T.StructField("high", id_type), T.StructField("agree", T.IntegerType())])
    return map_batches(both, run, schema)


def full_sets(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``rep, hashes`` (packed 64-bit shingles) of the documents whose id is in ``members.rep``."""
    texts = pick(docs, doc_id=id_col, text=text_col).join(members.select("rep"), F.col("doc_id") == F.col("rep")).select("rep", "text")

    def sets(batch: pa.RecordBatch) -> pa.Table:
        packed = [shingle_set(raw, words).tobytes() for raw in as_bytes(batch.column("text"))]
        return pa.table({"rep": batch.column("rep"), "hashes": pa.array(packed, pa.binary())})

    schema = T.StructType([T.StructField("rep", field_type(docs, id_col)), T.StructField("hashes", T.BinaryType())])
    return map_batches(texts, sets, schema)


def similar(common: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (one + other - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (low, high) whose full sets are similar enough; sets meet at ``low`` in bounded portions."""
    portions = pairs.groupBy("low").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    other = pairs.join(portions, "low").select(
        F.col("high").alias("rep"), F.col("low").alias("hub"), F.pmod(F.xxhash64("high"), F.col("portions")).cast("int").alias("portion"), F.lit(1).alias("role")
    )
    hubs = portions.select(F.col("low").alias("rep"), F.col("low").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("role"))
    # Sets grow with the texts: they are shuffled at any size.
    ready = sets.join(hubs.unionByName(other).hint("merge"), "rep").select("hub", "portion", "role", "rep", "hashes")
    dealt = ready.repartition("hub", "portion").sortWithinPartitions("hub", "portion", "role")

    def compare(batches):
        at, against = None, []
        for batch in batches:
            low, high = [], []
            columns = [batch.column(n).to_pylist() for n in ("hub", "portion", "role", "rep", "hashes")]
            for hub, portion, role, rep, raw in zip(*columns):
                if (hub, portion) != at:
                    at, against = (hub, portion), []
                mine = np.frombuffer(raw, np.uint64)
                if role == 0:
                    against.append(mine)
                elif any(similar(len(np.intersect1d(mine, x, assume_unique=True)), len(mine), len(x), percent) for x in against):
                    low.append(hub)
                    high.append(rep)
            yield pa.RecordBatch.from_pydict({"low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return dealt.mapInArrow(compare, "low long, high long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that both sides have."""
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    column = [np.searchsorted(shared, x) for x in flat]
    known = [(c < len(shared)) & (shared[np.minimum(c, max(0, len(shared) - 1))] == x) if len(shared) else np.zeros(len(x), bool) for c, x in zip(column, flat)]
    rows, column = [r[k] for r, k in zip(rows, known)], [c[k] for c, k in zip(column, known)]
    out = np.zeros((len(left), len(right)), dtype=np.float32)  # whole numbers are exact up to 2^24, more than a block row has
    for start in range(0, len(shared), COLUMNS):
        parts = []
        for n, r, c in zip((len(left), len(right)), rows, column):
            here = (c >= start) & (c < start + COLUMNS)
            part = np.zeros((n, min(COLUMNS, len(shared) - start)), dtype=np.float32)
            part[r[here], c[here] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what all the given pairs connect."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).tolist():
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def family_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between groups inside families: ``family, rep, grp`` to group pairs ``low, high``, perhaps repeated.

    Rows of groups below ``BLOCK`` members are dealt to blocks by a hash, rows of
    larger groups to blocks of their own kind, which only meet each other if the
    family has several such groups.
    """
    groups = rows.groupBy("family", "grp").agg(F.count("*").alias("n"))
    big = F.col("n") >= BLOCK
    families = groups.groupBy("family").agg(
        F.ceil(F.sum(F.when(~big, F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("small_blocks"),
        F.ceil(F.sum(F.when(big, F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("big_blocks"),
        F.count_if(big).alias("big_groups"),
        F.count("*").alias("n_groups"),
    )
    hashed = F.xxhash64(F.lit(11), "rep")
    sized = (
        rows.join(groups, ["family", "grp"])
        .join(families.where("n_groups > 1"), "family")
        .withColumn("big", big)
        .withColumn("mine", F.pmod(hashed, F.when(big, F.col("big_blocks")).otherwise(F.col("small_blocks"))).cast("int"))
    )
    mine, w, b = F.col("mine"), F.col("small_blocks"), F.col("big_blocks")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def seat(kind, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    alike = lambda kind, n: F.transform(up_to(n), lambda j: seat(kind, F.least(j, mine), F.greatest(j, mine), (j < mine)))
    small_seats = F.concat(alike("small", w), F.transform(up_to(b), lambda j: seat("mixed", mine, j, F.lit(0))))
    big_seats = F.concat(F.transform(up_to(w), lambda i: seat("mixed", i, mine, F.lit(1))), F.when(F.col("big_groups") > 1, alike("big", b)).otherwise(alike("big", F.lit(0))))
    dealt = (
        sized.select("family", "rep", "grp", F.explode(F.when(F.col("big"), big_seats).otherwise(small_seats)).alias("seat"))
        .select("family", "seat.*", "rep", "grp")
        .join(sets.hint("merge"), "rep")
    )

    def compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        _, kind, i, j = key
        left = block[block["side"] == 0]
        right = left if kind != "mixed" and i == j else block[block["side"] == 1]
        found = []
        if len(left) and len(right):
            sides = [[np.frombuffer(raw, np.uint64) for raw in x["hashes"]] for x in (left, right)]
            sizes = [np.array([len(s) for s in x]) for x in sides]
            one, other = left["grp"].to_numpy(), right["grp"].to_numpy()
            linked = similar(common_counts(*sides), sizes[0][:, None], sizes[1][None, :], percent) & (one[:, None] != other[None, :])
            p, q = np.nonzero(linked)
            found = spanning(one[p], other[q])
        return pd.DataFrame(found, columns=["low", "high"], dtype="int64")

    return dealt.groupBy("family", "kind", "i", "j").applyInPandas(compare, "low long, high long")


def _open_nodes(rows: DataFrame) -> DataFrame:
    """Nodes where groups meet: ``node``, the largest group ``top``, its members ``inside`` and the others ``outside``."""
    groups = rows.groupBy("node", "grp").agg(F.count("*").alias("n"))
    nodes = groups.groupBy("node").agg(F.sum("n").alias("all"), F.max(F.struct("n", "grp")).alias("most"))
    return nodes.where("all > most.n").select("node", F.col("most.grp").alias("top"), F.col("most.n").alias("inside"), (F.col("all") - F.col("most.n")).alias("outside"))


def _further(nodes: DataFrame) -> list[str]:
    return [c for c in nodes.columns if c not in ("node", "rep", "grp", "top", "inside", "outside")]


def seated(leaves: DataFrame) -> DataFrame:
    """Members of open nodes at their seats: ``node, i, j, mine, outsider, rep, grp`` and further columns.

    Outsiders and members of the largest group are dealt to blocks of their own. Seat
    (i, j) from i = 0 holds block i of the largest group and block j of the outsiders,
    and seat (-1 - i, j) two blocks of outsiders. As a leaf has one block of
    outsiders, a member of its largest group has one seat.
    """
    inner, outer = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("inside", "outside"))
    outsider = F.col("grp") != F.col("top")
    mine = F.pmod(F.xxhash64(F.lit(7), "rep"), F.when(outsider, outer).otherwise(inner)).cast("int")
    dealt = leaves.withColumns({"inner": inner, "outer": outer, "outsider": outsider, "mine": mine})
    seat = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    me = F.col("mine")
    others = F.transform(F.filter(up_to("outer"), lambda k: k != me), lambda k: seat(-1 - F.least(k, me), F.greatest(k, me)))
    seats = F.when(F.col("outsider"), F.concat(F.transform(up_to("inner"), lambda i: seat(i, me)), others)).otherwise(F.transform(up_to("outer"), lambda j: seat(me, j)))
    kept = ["mine", "outsider", "rep", "grp", *_further(leaves)]
    return dealt.select("node", F.explode(seats).alias("seat"), *kept).select("node", "seat.*", *kept)


def bridged(nodes: DataFrame) -> DataFrame:
    """Members of open nodes at seats where each outsider meets one block of the largest group.

    If there are more blocks of outsiders, the blocks of the largest group take turns, so that
    the seats never outnumber twice the members by more than a block.
    """
    inner, outer = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("inside", "outside"))
    outsider = F.col("grp") != F.col("top")
    dealt = nodes.withColumns({"inner": inner, "most": F.greatest(inner, outer), "outsider": outsider})
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(F.lit(13), "rep"), F.when(F.col("outsider"), F.col("most")).otherwise(F.col("inner"))).cast("int"))
    places = F.when(F.col("outsider"), F.array("mine")).otherwise(F.sequence(F.col("mine"), F.greatest("mine", F.col("most") - 1), F.col("inner")))
    return dealt.select("node", F.explode(F.transform(places, lambda k: k + 1)).alias("i"), F.lit(0).alias("j"), "mine", "outsider", "rep", "grp", *_further(nodes))


def agreeing_groups(seats: DataFrame) -> DataFrame:
    """Group pairs ``low, high`` with agreeing members at a seat, perhaps repeated; the members bring their ``marks``."""
    rows = seats.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")

    def flush(i, held):
        mine, outsider, grp, marks = (np.concatenate(x) for x in zip(*held))
        one, other = [], []
        left = np.flatnonzero(outsider & (mine == -1 - i) if i < 0 else outsider)
        right = np.flatnonzero(outsider & (mine != -1 - i) if i < 0 else ~outsider)
        for place, k in enumerate(left):
            rest = np.concatenate([right, left[place + 1 :]]) if i == 0 else right
            rest = rest[grp[rest] != grp[k]]
            near = np.unique(grp[rest[(marks[rest] == marks[k]).sum(axis=1) >= LEAST_AGREEING]])
            one += [grp[k]] * len(near)
            other += near.tolist()
        return spanning(np.array(one), np.array(other)) if one else []

    def run(batches):
        at, held = None, []
        links = lambda found: pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in found], pa.int64()) for k, n in enumerate(("low", "high"))})
        for batch in batches:
            node, i, j = (batch.column(n).to_numpy() for n in ("node", "i", "j"))
            columns = [batch.column("mine").to_numpy(), batch.column("outsider").to_numpy(zero_copy_only=False), batch.column("grp").to_numpy(), _matrix(batch.column("marks"))]
            change = np.flatnonzero((np.diff(node) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            edges, found = [0, *change.tolist(), len(node)], []
            for a, b in zip(edges, edges[1:]):
                here = (node[a], i[a], j[a])
                if here != at and held:
                    found += flush(at[1], held)
                    held = []
                at = here
                held.append([c[a:b] for c in columns])
            yield links(found)
        if held:
            yield links(flush(at[1], held))

    return rows.mapInArrow(run, "low long, high long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``. Ids are whole numbers."""
    rows = stage(sketches(docs, id_col, text_col, words), "sketches")
    keys = ["n_shingles", "f1", "f2"]
    classes = stage(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("first").alias("first"), F.first("marks").alias("marks")), "set-classes"
    )
    # First branches: one minwise token per tree.
    first = classes.select("rep", F.posexplode("first").alias("tree", "token")).select("rep", F.xxhash64("tree", "token").alias("node"))
    sizes = first.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    members = stage(first.join(sizes, "node"), "tree-nodes")
    stars = members.where("rep != pivot").select(F.col("pivot").alias("low"), F.col("rep").alias("high")).distinct()
    near = stage(agreeing_pairs(stars, classes), "star-pairs")
    families = components(near, "low", "high")
    label = lambda df, name: families.select(F.col("node").alias("rep"), F.col("component_id").alias(name)).join(df, "rep", "right").withColumn(name, F.coalesce(name, "rep"))
    # Pairs between families, from nodes where several meet.
    open_rows, small, level = label(members.where("n > 2").select("node", "rep"), "grp"), [], 0
    grown = lambda links: components(families.select(F.col("node").alias("low"), F.col("component_id").alias("high")).unionByName(links), "low", "high")
    # Sketches join the members of open nodes once and go with them from there.
    marked = lambda df: df.join(classes.select("rep", "marks").hint("merge"), "rep")
    wide = stage(marked(open_rows.join(_open_nodes(open_rows).where(F.col("outside") > LEAF), "node")), "wide-nodes")
    if not wide.isEmpty():
        families = grown(stage(agreeing_groups(bridged(wide)), "bridges"))
        open_rows = label(members.where("n > 2").select("node", "rep"), "grp")
    while True:
        open_rows = open_rows.join(_open_nodes(open_rows), "node")
        open_rows = stage(open_rows if level else marked(open_rows), "open-nodes")
        small.append(open_rows.where(F.col("outside") <= LEAF) if level < DEPTH else open_rows)
        large = open_rows.where(F.col("outside") > LEAF)
        if level == DEPTH or large.isEmpty():
            break
        level += 1
        drawn = lambda k, n: F.pmod(F.xxhash64("node", F.lit(level), F.lit(k)), F.lit(n)).cast("int")
        places = F.when(drawn(2, 2) == 0, F.array_distinct(F.array(drawn(0, SKETCH), drawn(1, SKETCH)))).otherwise(F.array(drawn(0, SKETCH)))
        branches = large.select("rep", "grp", "node", "marks", F.explode(places).alias("place"))
        open_rows = branches.select("rep", "grp", "marks", F.xxhash64("node", "place", F.substring("marks", F.col("place") + 1, F.lit(1))).alias("node"))
    # The leaves of all levels meet in one shuffle, as a node occurs in one level only.
    across = stage(agreeing_groups(seated(reduce(DataFrame.unionByName, small))), "pairs-across")
    if not across.isEmpty():  # families grow together
        families = grown(across)
    families = stage(families.select(F.col("node").alias("rep"), F.col("component_id").alias("family")), "families")
    sets = stage(full_sets(families, docs, id_col, text_col, words), "full-sets")
    best = near.groupBy("high").agg(F.max(F.struct(F.col("agree"), (-F.col("low")).alias("order"), F.col("low"))).alias("b")).select(F.col("b.low").alias("low"), "high")
    links = stage(confirm(best, sets, percent), "links")
    groups = components(links, "low", "high")
    rest = families.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("family", "rep", F.coalesce("component_id", "rep").alias("grp"))
    more = stage(family_links(stage(rest, "family-groups"), sets, percent), "links")
    if not more.isEmpty():
        known = groups.select(F.col("node").alias("low"), F.col("component_id").alias("high"))
        groups = components(known.unionByName(more), "low", "high")
    of_class = classes.select(*keys, "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", *keys).join(of_class, keys, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, a missing id counting as the largest.

    Rows are what is compared and removed, not ids: of rows with equal ids, or
    without one, each is judged by its own text. Where ids do not tell rows apart, the
    rows are numbered in the order of their ids first.
    """
    rows = keyed_rows(docs, id_col, text_col)
    gone = near_duplicates(rows, "key", "text", words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    gone = stage(gone, "near-copies")
    # It grows with the documents, so it can't be sent to all: the texts are shuffled once, at any size.
    return rows.join(gone.hint("merge"), F.col("key") == F.col("gone"), "left_anti").select("doc.*")
