"""Near-duplicate vectors and documents against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelens.llm import embedding_dedup, minhash_dedup
from judgelens.llm.components import components


def groups_of(nodes, links):
    """Smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "ring"])
def test_components(spark, shape):
    rng = random.Random(shape)
    ids = rng.sample(range(-500, 5000), 120)
    links = {
        "chain": list(zip(ids, ids[1:])),
        "star": [(ids[0], x) for x in ids[1:]],
        "random": [tuple(rng.sample(ids, 2)) for _ in range(70)],
        "ring": list(zip(ids, ids[1:] + ids[:1])),
    }[shape]
    links += links[:5] + [(ids[3], ids[3])]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    expected = groups_of(ids, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in expected.items() if n in linked}


def test_components_without_links(spark):
    links = spark.createDataFrame([(1, None), (2, 2)], "a long, b long")
    assert components(links, "a", "b").count() == 0


# Vectors


def brute_vectors(vectors, cosine=0.9):
    good = {k: np.array(v, float) for k, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, v in good.items()}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    counts = {k: sum(k in x for x in links) for k in vectors}
    groups = groups_of(vectors, links)
    return {k: (counts[k], groups[k], groups[k] == k) for k in vectors}


def crowded_vectors():
    rng = np.random.default_rng(6)
    vectors = {}
    for center in rng.normal(size=(12, 16)):
        for _ in range(int(rng.integers(1, 30))):
            vectors[len(vectors)] = (center + rng.normal(size=16) * rng.choice([0.05, 0.3])).tolist()
    crowd = rng.normal(size=16)
    for _ in range(60):
        vectors[len(vectors)] = (crowd + rng.normal(size=16) * 0.2).tolist()
    for _ in range(80):
        vectors[len(vectors)] = rng.normal(size=16).tolist()
    for k in (3, 3, 3, 7):
        vectors[len(vectors)] = vectors[k]
    vectors[len(vectors)] = [x * 1e200 for x in vectors[5]]
    vectors[len(vectors)] = [x * 1e-200 for x in vectors[5]]
    for odd in (None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [1.0, 2.0], [2.0, 4.0]):
        vectors[len(vectors)] = odd
    return vectors


@pytest.mark.parametrize("per_cell, block", [(4096, 4096), (25, 10), (8, 64)])
def test_vector_links_equal_all_pairs(spark, per_cell, block):
    vectors = crowded_vectors()
    rows = spark.createDataFrame([(k, v, "x", 7) for k, v in vectors.items()], "vec_id long, embedding array<double>, label string, n_links int")
    got = embedding_dedup.near_duplicates(rows, per_cell=per_cell, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(vectors) and len(got) == len(vectors)


def test_vector_rows_that_repeat_or_have_no_id(spark):
    rows = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (2, [0.99, 0.1]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(rows).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(2, 1, 2, True), (5, 1, 2, False), (5, 1, 2, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


@pytest.mark.parametrize("number", ["float", "double", "int"])
def test_packed_vectors(spark, number):
    vectors = {1: [1, -0.0, 2], 2: [], 3: None, 4: [0, 0], 5: [1, None], 6: [3], None: [1, 2]}
    odd = {} if number == "int" else {7: [float("nan"), 1.0], 8: [1.0, float("inf")]}
    rows = spark.createDataFrame([(k, v and [None if x is None else float(x) for x in v]) for k, v in (vectors | odd).items()], "vec_id long, v array<double>")
    rows = rows.select("vec_id", F.col("v").cast(f"array<{number}>").alias("v"))
    got = {r.vec_id: np.frombuffer(bytes(r.v), "<f4" if number == "float" else "<f8").tolist() for r in embedding_dedup.packed(rows).collect()}
    assert got == {1: [1.0, 0.0, 2.0], 6: [3.0]} and not np.signbit(got[1][1])


def test_links_of_many_visitors_in_single_precision(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(300, 24)).astype(np.float32)
    near = points + rng.normal(size=points.shape).astype(np.float32) * np.float32(0.48) * rng.random((300, 1)).astype(np.float32)
    vectors = {k: v.tolist() for k, v in enumerate(np.concatenate([points, near]))}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(rows, per_cell=30, block=16).collect()}
    assert got == brute_vectors(vectors) and 100 < sum(n for n, _, _ in got.values()) < 600


def test_no_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").limit(0)
    assert embedding_dedup.near_duplicates(rows).count() == 0


def test_compared_blocks_are_bounded(spark):
    rng = np.random.default_rng(1)
    classes = spark.createDataFrame([(k, 1, bytearray((np.ones(8) + rng.normal(size=8) * 0.01).tobytes())) for k in range(600)], "rep long, copies long, v binary")
    placed = embedding_dedup.place(classes, {64: np.eye(1, 8)}, "<f8", 0.3)
    dealt = embedding_dedup.deal_blocks(placed, 50)
    assert dealt.groupBy("width", "cell", "i", "j", "kind").count().agg(F.max("count")).first()[0] < 4 * 50


# Documents


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute_documents(texts, size=5, percent=80):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    groups = groups_of(texts, links)
    return {k: (len(sets[k]), groups[k], groups[k] == k) for k in texts}


def crowded_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(40):  # near copies of many degrees
        base = [word() for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    crowd = [word() for _ in range(60)]
    for _ in range(150):  # a large group of near copies
        copy = list(crowd)
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for _ in range(150):  # other texts that share a passage
        texts.append(" ".join([word() for _ in range(5)] + passage + [word() for _ in range(rng.randint(2, 20))]))
    texts += [texts[0]] * 30 + [texts[0].upper(), texts[1].replace(" ", "\n\t")]
    texts += [None, "", " \n", "one", "One", "one two", "two one", "one two three four", "long " * 30_000, "long " * 20_000, "a\xa0b c d e", "a b c d e"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("words, block", [(4, 12), (5, 1024)])
def test_document_links_equal_all_pairs(spark, words, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LEAF", 20)
    monkeypatch.setattr(minhash_dedup, "PORTION", 16)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    texts = crowded_texts()
    rows = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, rep int, node string")
    got = minhash_dedup.near_duplicates(rows, words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_documents(texts, words) and len(got) == len(texts)


def test_leaves_of_all_levels_meet_at_once(spark, monkeypatch):
    """However many levels branch, members are compared twice: at the bridges and at the leaves."""
    monkeypatch.setattr(minhash_dedup, "LEAF", 5)
    levels, compared, stage, agreeing = [], [], minhash_dedup.stage, minhash_dedup.agreeing_groups
    monkeypatch.setattr(minhash_dedup, "stage", lambda df, name: levels.append(name) or stage(df, name))
    monkeypatch.setattr(minhash_dedup, "agreeing_groups", lambda seats: compared.append(1) or agreeing(seats))
    texts = crowded_texts()
    got = minhash_dedup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string"), words=4).collect()
    assert levels.count("open-nodes") > 2 and len(compared) == 2
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_documents(texts, 4)


def test_components_of_repeated_stars(spark):
    """Stars need no round, and repeated links give each node once."""
    links = spark.createDataFrame([(1, 5), (5, 1), (1, 5), (1, 9), (4, 2), (3, 3), (None, 1)], "a long, b long")
    assert sorted(components(links, "a", "b").collect()) == [(1, 1), (2, 2), (4, 2), (5, 1), (9, 1)]


@pytest.mark.parametrize("inside, outside", [(5000, 3), (900, 90), (40, 0)])
def test_seats_of_a_node_grow_with_its_members(spark, inside, outside, monkeypatch):
    """A large family has one seat a member beside few outsiders, who visit each of its blocks; a node of one family has none."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 256)
    rows = spark.range(inside + outside).selectExpr("1L AS node", "id AS rep", f"IF(id < {inside}, 0L, id) AS grp")
    seats = minhash_dedup.seated(rows.join(minhash_dedup._open_nodes(rows), "node"))
    counts = {r.outsider: r["count"] for r in seats.groupBy("outsider").count().collect()}
    assert counts == ({False: inside, True: outside * -(-inside // 256)} if outside else {})


@pytest.mark.parametrize("inside, outside", [(5000, 300), (300, 5000), (1, 3)])
def test_bridges_grow_with_the_members(spark, inside, outside, monkeypatch):
    """Each outsider has one seat, where at least one member of the largest group sits."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 256)
    rows = spark.range(inside + outside).selectExpr("1L AS node", "id AS rep", f"IF(id < {inside}, 0L, id) AS grp", "0L AS top", f"{inside}L AS inside", f"{outside}L AS outside")
    seats = minhash_dedup.bridged(rows).collect()
    visited = {r.i for r in seats if not r.outsider}
    assert sorted(r.rep for r in seats if r.outsider) == list(range(inside, inside + outside))
    assert {r.i for r in seats if r.outsider} <= visited and len(seats) <= 2 * (inside + outside) + 256


def test_every_two_groups_share_a_seat(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rows = spark.range(60).selectExpr("1L AS node", "id AS rep", "IF(id < 20, 0L, id) AS grp")
    seats = minhash_dedup.seated(rows.join(minhash_dedup._open_nodes(rows), "node")).collect()
    met = set()
    for i, j in {(r.i, r.j) for r in seats}:
        here = [r for r in seats if (r.i, r.j) == (i, j)]
        for a, b in itertools.combinations(here, 2):
            inner = a.outsider and b.outsider and (i == 0 if a.mine == b.mine else i < 0)
            if inner or a.outsider != b.outsider:
                assert (pair := (min(a.rep, b.rep), max(a.rep, b.rep))) not in met
                met.add(pair)
    assert met == {(a, b) for a, b in itertools.combinations(range(60), 2) if b >= 20}


def test_similarity_at_the_border(spark):
    """Sets of 4 and 5 shingles with 4 in common are linked at 80 percent, 4 of 6 are not."""
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(1, text), (2, text + " i"), (3, text + " j k")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(rows, words=5).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_documents_that_repeat_or_have_no_id(spark):
    rows = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (9, "a b c"), (None, "a b c"), (None, "x y z"), (7, None)], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(rows).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True), (7, 7, True), (9, 4, False)]


def test_kept_documents_have_their_columns_once(spark):
    rows = spark.createDataFrame([(4, "a b c", 1), (4, "a b c", 1), (9, "a b c", 2), (7, None, 3), (8, "other text", 4)], "doc_id long, text string, _gone int")
    left = minhash_dedup.distinct_documents(rows)
    assert left.columns == rows.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 7, 8]


def test_stars_need_no_further_round(spark, monkeypatch):
    from judgelens.llm import components as module

    rounds, stage = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    links = spark.createDataFrame([(1, 5), (7, 1), (2, 9), (9, 2), (None, 3)], "a long, b long")
    assert {r.node: r.component_id for r in components(links, "a", "b").collect()} == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2}
    assert len(rounds) == 1


def test_members_bring_their_sketches_to_their_seats(spark):
    rows = spark.createDataFrame([(1, k, 0 if k < 4 else k, bytes([k])) for k in range(6)], "node long, rep long, grp long, marks binary")
    nodes = rows.join(minhash_dedup._open_nodes(rows), "node")
    for seats in (minhash_dedup.seated(nodes), minhash_dedup.bridged(nodes)):
        assert {(r.rep, bytes(r.marks)) for r in seats.collect()} == {(k, bytes([k])) for k in range(6)}


def test_no_documents(spark):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0)
    assert minhash_dedup.near_duplicates(rows).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    agree = [(minhash_dedup.sketch(base[:800]) == minhash_dedup.sketch(np.concatenate([base[:700], base[800:]]))).mean()]
    for _ in range(30):
        base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        agree.append((minhash_dedup.sketch(base[:800]) == minhash_dedup.sketch(np.concatenate([base[:700], base[800:]]))).mean())
    assert abs(np.mean(agree) - 700 / 900) < 0.03


def test_distinct_documents_goes_by_rows(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80))
    first, clean, lone = text(), text(), text()
    near, alone = lone + " tail", text()
    rows = [(1, first), (5, first), (5, clean), (7, clean), (None, lone), (None, near), (None, alone), (9, ""), (9, ""), (8, None), (3, alone), (3, alone)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _row string, _gone int")
    left = minhash_dedup.distinct_documents(df)
    assert left.columns == df.columns
    found = [(r.doc_id, r.text) for r in left.collect()]
    expected = [(1, first), (5, clean), (9, ""), (9, ""), (8, None), (3, alone)]
    assert sorted(map(str, found)) in (sorted(map(str, [*expected, (None, lone)])), sorted(map(str, [*expected, (None, near)])))
