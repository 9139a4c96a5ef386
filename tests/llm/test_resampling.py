"""Importance resampling against a plain sort."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from judgelens.llm import resampling

DOCS = "doc_id long, text string"


def features(text, longest):
    words, word = [], bytearray()
    for b in (text or "").encode() + b" ":
        if 65 <= b <= 90:
            b += 32
        if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128:
            word.append(b)
        elif word:
            words.append(bytes(word))
            word.clear()
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, min_words=20, buckets=10_000, longest=1, seed=2024):
    counts = [Counter(zlib.crc32(f) % buckets for text in texts for f in features(text, longest)[1]) for texts in ([t for _, t in docs], target)]
    s, t = counts
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for doc_id, text in docs:
        words, some = features(text, longest)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in some) // len(some) if some else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(some), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[: percent * len(able) // 100]
    return rows, [r[:4] for r in drawn]


def corpus(rng, n=400):
    words = ["the", "Of", "straße", "n1", "x", "日本", "é", "alpha", "beta", "gamma"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=range(1, 11), k=rng.choice([0, 3, 19, 20, 21, 60])))) for i in rng.sample(range(10_000), n)]
    docs += [(docs[0][0], docs[0][1])] * 3 + [(docs[1][0], "other " * 25)]  # repeated rows, a repeated id
    return docs + [(None, "beta " * 30), (None, "beta " * 30), (11_000, None), (11_001, ""), (11_002, "gamma, " * 300_000)]


@pytest.mark.parametrize("options", [{}, {"longest": 2, "buckets": 64, "percent": 37}, {"percent": 100, "min_words": 0}, {"percent": 0}])
def test_resampling_equals_a_plain_sort(spark, options):
    rng = random.Random(str(options))
    docs, target = corpus(rng), ["gamma beta gamma", None, "", "beta Gamma alpha"]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), **options).collect()
    rows, drawn = brute(docs, target, **options)
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in rows), key=str)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == [(r[3], r[0]) for r in drawn]


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "text string")
    clash = spark.createDataFrame([(1, "a b " * 20, 5, "x", 7, 8)], DOCS + ", score int, rank string, k1 int, n_words int")
    (row,) = resampling.resample(clash, none, percent=100).collect()
    assert (row.doc_id, row.n_features, row["rank"]) == (1, 40, 1)
    empty = resampling.resample(clash.limit(0), none)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]


@pytest.mark.parametrize("kind", ["distinct", "one score", "two scores", "sorted"])
def test_cutoff_is_exact_and_every_turn_discards_a_quarter(spark, kind):
    rng = random.Random(kind)
    n = 5000
    k1 = {"distinct": rng.sample(range(-(10**6), 10**6), n), "one score": [7] * n, "two scores": [rng.choice([1, 2]) for _ in range(n)], "sorted": list(range(n))}[kind]
    keys = [(a, rng.randrange(50), i) for i, a in enumerate(k1)]
    df = spark.createDataFrame(keys, "k1 long, k2 long, k3 long").repartition(7 if kind != "sorted" else 1)
    for wanted in (1, 2, 499, 2500, n - 1, n):
        log = []
        assert resampling.cutoff_key(df, wanted, log) == sorted(keys)[wanted - 1]
        assert all(b <= 0.75 * a + 1 for a, b in zip(log, log[1:])), log
    assert resampling.cutoff_key(df, 0) is None and resampling.cutoff_key(df, n + 1) is None
