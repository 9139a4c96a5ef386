"""Exact search and vector codes against plain loops over all rows."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from judgelens.llm import vector_codes, vector_search
from judgelens.llm.vectors import LIMIT

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [max(-LIMIT, min(LIMIT, math.floor(256 * float(np.float32(x))))) for x in v]


def odd_rows(rng, width=6, n=120):
    """Random vectors with copies, ties, zeros, and all that takes no part."""
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.6, rng.uniform(-1, 1)]) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(20)]  # copies
    rows += [(n + 30, [0.0] * width, 2), (n + 31, None, 2), (n + 32, [1.0] * (width - 1) + [None], 2), (n + 33, [float("nan")] * width, None)]
    rows += [(n + 34, [float("inf")] + [0.0] * (width - 1), None), (None, [0.5] * width, 3), (n + 35, [], 3), (n + 36, [], 3), (n + 37, [0.1] * (width + 1), None), (n + 38, [0.2] * (width + 1), None)]
    return rows + [(10, rows[10][1], rows[10][2]), (10, rows[11][1], 0)]  # repeated ids


def brute_search(rows, queries, k, own=True):
    out = []
    for a, (qid, q, *_) in enumerate(queries):
        scores = sorted((-sum(x * y for x, y in zip(whole(q), whole(v))), vid) for b, (vid, v, *_) in enumerate(rows) if vid is not None and usable(v) and len(v) == len(q) and not (own and rows[b] is queries[a]))
        out += [(qid, r + 1, vid, -s) for r, (s, vid) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 4, "region": 16, "pack": 3, "band": 2, "per_task": 5}), (3, {"block": 1, "region": 1, "k": 2})])
def test_search_equals_all_rows(spark, seed, options):
    rows = odd_rows(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    queries = [r for r in rows if r[0] is not None and usable(r[1]) and r[0] % 5 == 0]
    assert found(vector_search.search(df, every=5, **options)) == brute_search(rows, queries, options.get("k", 5))


def test_search_with_own_queries_and_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([rng.uniform(-1e6, 1e6), 3e38, -3e38, 0.001]) for _ in range(5)], 0) for i in range(60)]
    queries = [(i, [rng.uniform(-1e5, 1e5) for _ in range(5)], 0) for i in range(7)] + [(7, rows[7][1], 0), (8, None, 0), (None, rows[8][1], 0)]
    got = vector_search.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, SCHEMA), block=4, region=8)
    assert found(got) == brute_search(rows, queries[:8], 5, own=False)


def test_search_of_few_rows_none_and_clashing_columns(spark):
    names = "vec_id long, embedding array<float>, row string, region string, score string, rank string, key string, width string"
    more = ["x"] * 6
    one = spark.createDataFrame([(0, [1.0, 2.0], *more)], names)
    assert vector_search.search(one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], *more), (1, [1.0, 0.0], *more)], names)
    assert found(vector_search.search(two)) == [(0, 1, 1, 65536), (1, 1, 0, 65536)]
    empty = vector_search.search(one.limit(0))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_blocks_are_skipped_where_neighbours_are_alike():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(64, 32)) * 100
    m = np.repeat(centers, 64, axis=0) + rng.normal(size=(4096, 32)) * 5
    m = np.floor(m).astype(np.int32)
    q = m[::100]
    hit, ids, scores, scored = vector_search.search_blocks(q, np.arange(len(m))[::100], np.full(len(q), np.nan), m, np.arange(len(m)), np.arange(len(m)), 32, 5)
    everything = q.astype(np.int64) @ m.T
    everything[np.arange(len(q)), np.arange(len(m))[::100]] = -(1 << 60)
    for k in range(len(q)):
        best = np.lexsort((np.arange(len(m)), -everything[k]))[:5]
        assert ids[hit == k].tolist() == best.tolist() and scores[hit == k].tolist() == everything[k][best].tolist()
    assert scored.max() < len(m) / 4 and scored.min() >= 5


def test_a_floor_spares_blocks_but_loses_no_tie():
    m = np.array([[3], [3], [2], [3], [1], [3]], dtype=np.int32)
    hit, ids, scores, scored = vector_search.search_blocks(np.array([[2]]), np.array([-1]), np.array([6.0]), m, np.arange(6), np.array([9, 8, 7, 6, 5, 4]), 1, 3)
    assert ids.tolist() == [4, 6, 8] and scores.tolist() == [6, 6, 6] and scored.tolist() == [4]


# Codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, whole(v), label) for i, v, label in rows if usable(v)]
    with_id = sorted([r[:2] for r in kept if r[0] is not None])
    width = len(with_id[0][1])
    length = width // parts
    cut = lambda v, p: v[p * length : (p + 1) * length]
    books = [[cut(v, p) for _, v in [x for x in with_id if len(x[1]) == width][:entries]] for p in range(parts)]
    able = [r for r in kept if len(r[1]) == width]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: [min(range(len(books[p])), key=lambda e: (away(cut(v, p), books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes = [near(v) for _, v, _ in able]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(able, codes) if c[p] == e]
                if own:
                    books[p] = [*books[p][:e], [sum(x) // len(own) for x in zip(*own)], *books[p][e + 1 :]]
    out = []
    for i, v, label in able:
        code = near(v)
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(away(cut(v, p), books[p][c]) for p, c in enumerate(code))))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, code, error, sums[label], digest) for i, label, code, error in out]
    return sorted(coded + [(i, None, None, None, digest) for i, v, _ in kept if len(v) != width], key=str)


@pytest.mark.parametrize("seed, parts, entries, rounds", [(1, 2, 8, 2), (2, 3, 5, 6), (3, 6, 200, 1), (4, 1, 1, 3), (5, 2, 16, 0)])
def test_codes_equal_full_scans(spark, seed, parts, entries, rounds):
    rows = odd_rows(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds).collect()]
    assert sorted(got, key=str) == brute_codes(rows, parts, entries, rounds)


def test_codes_without_rows_or_equal_parts(spark):
    rows = [(1, [0.5] * 5, 1), (2, [0.25] * 5, None), (3, None, 1)]
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), parts=2).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in sorted(got)] == [(1, None, None, None), (2, None, None, None)]
    empty = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    clash = spark.createDataFrame([(1, [0.5, 0.25], 1, "x", "y", "z")], SCHEMA + ", v string, code string, state string")
    assert [r.code for r in vector_codes.compress(clash, parts=2).collect()] == ["0000"]


def full_scan(points, book):
    return np.stack([vector_codes.squared_distances(points[:, p], book[p]).argmin(axis=1) for p in range(points.shape[1])], axis=1)


def test_bounds_spare_scans_and_change_no_code():
    rng = np.random.default_rng(6)
    centers = rng.integers(-2000, 2000, size=(16, 3, 4))
    points = (centers[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, size=(3000, 3, 4))).astype(np.int32)
    history = [points[:24].transpose(1, 0, 2).astype(np.int64)]
    state, scans = (None, None, None), []
    for _ in range(8):
        *state, n = vector_codes.assign(points, *state, history, vector_codes.displacements(history))
        scans.append(int(n.sum()))
        assert (state[0] == full_scan(points, history[-1])).all()
        means = history[-1].copy()
        for p, e in itertools.product(range(3), range(24)):
            own = points[state[0][:, p] == e, p].astype(np.int64)
            if len(own):
                means[p, e] = own.sum(axis=0) // len(own)
        history.append(means)
    assert scans[0] == 9000 and scans[-1] < 0.35 * scans[0]


def test_displacement_is_the_net_one():
    there_and_back = [np.array([[[0, 0], [9, 9]]]), np.array([[[5, 0], [9, 9]]]), np.array([[[0, 0], [9, 8]]])]
    assert vector_codes.displacements(there_and_back)[0].tolist() == [[1.0, 0.0]]
