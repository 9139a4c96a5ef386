"""Toxicity, mixing and the pipeline on small tables with known answers."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from judgelens.llm import minhash_dedup, mixing, toxicity
from judgelens.llm.common import table

BAD_STEMS = ("grumbl", "zorkan")


def prose(rng, n, toxic=False):
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(n)]
    for _ in range(2 if toxic else 0):
        words[rng.randrange(n)] = rng.choice(BAD_STEMS) + "".join(rng.choices("aeiou", k=3))
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    labels = [int(rng.random() < 0.2) for _ in range(500)]
    return [prose(rng, rng.randint(20, 200), bool(y)) for y in labels], labels


def test_model_finds_stems_from_document_labels(labelled):
    texts, labels = labelled
    model = toxicity.fit(texts[:400], labels[:400])
    got = [model.score(t) >= 0.5 for t in texts[400:]]
    assert np.mean([g == bool(y) for g, y in zip(got, labels[400:])]) >= 0.97
    clean = prose(random.Random(2), 20_000)
    assert model.score(clean) < 0.5  # length alone is no evidence
    assert model.score(clean + ". You zorkanxyz grumbleee! " + clean) >= 0.5


def test_scores_combine_sentences_by_noisy_or(labelled):
    model = toxicity.fit(*labelled)
    text = "Nothing here. zorkanae! Some grumbliou and zorkanoo\nthe end"
    scores = model.sentence_scores(toxicity.sentences(text))
    assert model.score(text) == pytest.approx(1 - np.exp(-model.leak) * np.prod(1 - scores))
    assert scores[0] == 0 and scores[1] > 0 and model.score(None) == model.score("") == pytest.approx(1 - np.exp(-model.leak))


def test_model_without_both_labels():
    assert toxicity.fit([], []).score("x") == 0
    assert toxicity.fit(["a", "b"], [0, 0]).score("a") == 0
    assert toxicity.fit(["a", "b"], [1, 1]).score("q") > 0.99


def toxic_frames(spark, labelled):
    texts, labels = labelled
    docs = spark.createDataFrame([(k, t, "clash", k % 2) for k, t in enumerate(texts)] + [(900, None, "clash", 0), (None, "zorkanae grumbliii", "clash", 0)], "doc_id long, text string, score string, label int")
    marks = spark.createDataFrame([(k, y, 1) for k, y in enumerate(labels)] + [(900, None, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    return docs, marks


def test_score_rows_and_located_sentences(spark, labelled):
    docs, marks = toxic_frames(spark, labelled)
    model = toxicity.train(docs, marks)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == 502
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [(r.predicted, labelled[1][r.doc_id]) for r in rows if r.held_out and r.doc_id < 500]
    assert np.mean([a == b for a, b in held]) >= 0.95
    for r in toxicity.locate(docs.where("doc_id < 100"), model).collect():
        assert any(stem in labelled[0][r.doc_id][r.start : r.end] for stem in BAD_STEMS)
    left = toxicity.harmless_documents(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_held_out_labels_change_nothing(spark, labelled):
    docs, marks = toxic_frames(spark, labelled)
    other = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(docs, marks), toxicity.train(docs, other)
    assert np.array_equal(one.weights, two.weights) and (one.bias, one.leak) == (two.bias, two.leak)


def test_training_sample_is_bounded(spark, labelled, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, weights: seen.append((len(texts), np.average(labels, weights=weights))))
    docs, marks = toxic_frames(spark, labelled)
    toxicity.train(docs, marks, max_per_label=20)
    rest = [y for k, y in enumerate(labelled[1]) if zlib.crc32(str(k).encode()) % 5]
    assert seen[0][0] == 40 and seen[0][1] == pytest.approx(np.mean(rest))


def test_toxicity_of_empty_tables(spark, labelled):
    docs, marks = toxic_frames(spark, labelled)
    model = toxicity.train(docs.limit(0), marks.limit(0))
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


# Mixing


def targets_of(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Sources by code point, null last; the excess of full sources is shared again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        unit = max(0.0, total - sum(out.values())) / sum(weight[s] for s in left)
        full = {s for s in left if most * sizes[s] <= unit * weight[s]}
        if not full:
            out |= {s: unit * weight[s] for s in left}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= full
    return out


def mixed_rows(spark, seed, n=900):
    rng = random.Random(seed)
    names = ["src1", "src10", "src2", "", "Ä", "z", None]
    return spark.createDataFrame(
        [(k, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), rng.choices(names, [30, 2, 4, 3, 1, 1, 2])[0], "clash", 1) for k in range(n)]
        + [(n + 1, None, "z", "x", 1), (n + 2, "", "only empty", "x", 1), (None, "a b c", "src2", "x", 1)],
        "doc_id long, text string, source string, size string, copies int",
    )


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 40), (3, 7)])
def test_mix_meets_targets(spark, seed, block):
    docs = mixed_rows(spark, seed)
    rows = mixing.mix(docs, block=block).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    expected = targets_of(dict(sizes))
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken, docs_taken, docs_expected, most = Counter(), Counter(), Counter(), Counter()
    for r in rows:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(expected[r.source]))
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        docs_taken[r.source] += r.copies
        docs_expected[r.source] += r.target / r.source_size if r.source_size else 0
        most[r.source] = max(most[r.source], r.size)
    for source, target in expected.items():
        assert abs(taken[source] - target) <= max(1, most[source])
        assert abs(docs_taken[source] - docs_expected[source]) <= 6
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7), block=block).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_walk_keeps_totals_and_chances():
    sizes = [float(random.Random(3).randint(1, 50)) for _ in range(40)]
    sums = np.zeros(40)
    for seed in range(1500):
        out = mixing.walk(sizes, [0.3] * 40, random.Random(seed))
        assert sum(0 < p < 1 for p in out) <= 2
        assert sum(out) == pytest.approx(12) and np.dot(sizes, out) == pytest.approx(0.3 * sum(sizes))
        sums += out
    assert np.abs(sums / 1500 - 0.3).max() < 0.06


def test_mixed_documents_repeat_rows(spark):
    docs = mixed_rows(spark, 4, 200)
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == {k: n for k, n in taken.items() if n}


@pytest.mark.parametrize("one_text", [False, True])
def test_rows_of_one_id_are_dealt_to_bounded_blocks(spark, monkeypatch, one_text):
    ids = [None] * 300 + [7] * 300 + list(range(100, 160))
    rows = [(k, "same words here" if one_text else " ".join(["w"] * (1 + i % 9)), "a" if i % 20 else "b") for i, k in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups, fly = spark.sparkContext.accumulator(0), mixing._fly

    def counted(seed, level):
        def run(key, frame):
            groups.add(1)
            assert len(frame) <= 40 or frame["number"].max() - frame["number"].min() >= 40 and len(frame) <= 44
            return fly(seed, level)(key, frame)

        return run

    monkeypatch.setattr(mixing, "_fly", counted)
    out = mixing.mix(docs, block=40).collect()
    assert groups.value >= 660 / 40 and len(out) == 660
    for source in "ab":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9
    monkeypatch.setattr(mixing, "_fly", fly)
    sizes, total = Counter(), Counter()
    for r in mixing.mixed_documents(docs, block=40).collect():
        total[r.source] += len(r.text.split())
    for r in out:
        sizes[r.source] = r.target
    assert all(abs(total[x] - sizes[x]) <= 9 for x in sizes)


@pytest.mark.parametrize("stage_of", ["mix", "near copies"])
def test_texts_meet_their_decisions_the_same_way_at_any_size(spark, stage_of):
    docs = mixed_rows(spark, 4, 60)
    joined = mixing.mixed_documents(docs) if stage_of == "mix" else minhash_dedup.distinct_documents(docs)
    plan = joined._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [("SortMergeJoin" in line) for line in plan if "Join" in line and ("[taken#" in line or "[gone#" in line)] == [True]


def test_mix_of_nothing_and_of_empty_texts(spark):
    docs = mixed_rows(spark, 4, 20)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {(r.target, r.taken) for r in mixing.mix(docs.withColumn("text", F.lit(""))).collect()} == {(0.0, 0)}


# Pipeline


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_dedup", "source_mixing", "best_fit_packing"]
    before = {r.doc_id for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        after = {r.doc_id for r in out.collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
        docs, before = spark.createDataFrame(out.collect(), out.schema), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == before
    direct = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.piece, r.length) for r in direct.collect()) == sorted((r.doc_id, r.piece, r.length) for r in packed)
