"""Token ids, Simple-8b tables and packing against the tokenizers library and plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from judgelens.llm import packing, token_files, tokens
from judgelens.llm.common import tokenizer_file

BITS = ["a", "b", "é", "ñ", "1", "2", ".", ",", "!?", "\n", "\n\n", " ", "  ", "\t", "'s", "'", "###", "中", "\x1c", ";:", "I'm", "\r\n", "🙂", "<|endoftext|>", " "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def reference(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], dtype="<u4")


def odd_texts(seed=3):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += [" ".join("".join(rng.choices(BITS, k=rng.randint(1, 4))) for _ in range(12)) for _ in range(600)]
    return texts + [None, "", " ", "  lead", "trail  ", "x" * 5000, "word, " * 3000, "A line.\nAnother line.\nThird"]


@pytest.mark.parametrize("memo", [10, 1_000_000])
def test_column_encoding_equals_the_library(tokenizer, memo):
    own, texts = tokens.WordEncoder(tokenizer_file(), memo=memo), odd_texts()
    for start in range(0, len(texts), 300):
        part = texts[start : start + 300]
        ids, ends = own.encode(pa.array(part, pa.string()))
        for text, a, b in zip(part, [0, *ends[:-1]], ends):
            assert ids[a:b].tolist() == reference(tokenizer, text).tolist(), repr(text)


@pytest.mark.parametrize("memo", [10, 1_000_000])
def test_added_tokens_get_their_ids(memo):
    untouched, own = Tokenizer.from_file(tokenizer_file()), tokens.WordEncoder(tokenizer_file(), memo=memo)
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"a{end}b", f"{end}{end} x", f"one two {end}", f"{end}\n{end}", f"a\n{end}\nb.", "<|endoftext |>", "a b", None]
    texts += [text for seed in (8, 9) for text in odd_texts(seed)]
    for start in range(0, len(texts), 300):
        part = texts[start : start + 300]
        ids, ends = own.encode(pa.array(part, pa.string()))
        for text, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
            assert ids[a:b].tolist() == reference(untouched, text).tolist(), repr(text)
    assert own.encode(pa.array([f"a {end} b"]))[0].tolist() == [64, 220, 50256, 275, tokens.END_ID]


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (5, 0, 900, 3, 3, 3)] + [None])
    got = list(tokens.slices(texts, 10))
    assert [a for a, _ in got] == [0] + [b for _, b in got[:-1]] and got[-1][1] == len(texts)
    assert list(tokens.slices(texts.slice(0, 0), 10)) == []


# Simple-8b


def random_values(rng, n):
    values = [int(rng.integers(0, 1 << int(b))) if b < 63 else (1 << 63) + int(rng.integers(0, 1 << 62)) for b in rng.integers(0, rng.integers(1, 65), size=n)]
    return np.array(values, dtype=np.uint64)


@pytest.mark.parametrize("seed", range(60))
def test_simple8b_round_trip_and_ranges(seed):
    rng = np.random.default_rng(seed)
    values = random_values(rng, int(rng.integers(1, 900)))
    if seed % 5 == 0:
        values[: len(values) // 2] = 0
    if seed % 7 == 0:
        values[0], values[-1], values[len(values) // 2] = (1 << 60) - 1, (1 << 60) - 2, (1 << 64) - 1
    raw, marks = token_files.encode_block(values)
    assert np.array_equal(token_files.decode_block(raw), values)
    for _ in range(10):
        a, b = sorted(rng.integers(0, len(values) + 1, 2).tolist())
        assert np.array_equal(token_files.decode_range(raw, marks, a, b), values[a:b])


def test_simple8b_words_are_as_full_as_they_can_be():
    for bits, per_word in ((1, 60), (2, 30), (7, 8), (16, 3), (15, 4), (40, 1)):
        values = np.full(per_word * 50, (1 << bits) - 1, dtype=np.uint64)
        assert len(token_files.encode_words(values)) == 50
    assert len(token_files.encode_words(np.zeros(2400, np.uint64))) == 10
    assert len(token_files.encode_words(np.zeros(0, np.uint64))) == 0


def document_frame(spark, texts, ids=None):
    rows = [(k, t, "clash", "clash") for k, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, part string").repartition(3)


@pytest.mark.parametrize("block_ids", [1, 50, 1 << 16])
def test_token_table_equals_the_library(spark, tokenizer, block_ids):
    texts = odd_texts(5)[:200] + [None, "", "x " * 3000]
    ids = random.Random(1).sample(range(10_000), len(texts))
    got = token_files.token_table(document_frame(spark, texts, ids), block_ids=block_ids).orderBy("doc_id").collect()
    start = 0
    for r, (doc_id, text) in zip(got, sorted(zip(ids, texts), key=lambda x: x[0]), strict=True):
        expected = reference(tokenizer, text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc_id, start, len(expected), zlib.crc32(expected.tobytes()), expected.tobytes())
        start += len(expected)


def test_token_table_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(2, "b"), (2, "a"), (None, "c d"), (2, "a"), (1, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_files.token_table(docs, with_ids=False).orderBy("start").collect()]
    assert got == [(None, 0, 3), (1, 3, 1), (2, 4, 2), (2, 6, 2), (2, 8, 2)]
    assert token_files.token_table(docs.limit(0)).count() == 0


def test_shuffled_ids_take_two_bytes_where_they_fit():
    ids, stops = np.array([7, 65535, 2, 2], dtype="<u4"), np.array([3, 3, 4])
    narrow = token_files.packed_ids(ids, stops, False).to_pylist()
    assert narrow == [ids[:3].astype("<u2").tobytes(), b"", ids[3:].astype("<u2").tobytes()]
    assert token_files.packed_ids(ids + 1, stops, True).to_pylist() == [(ids[:3] + 1).tobytes(), b"", (ids[3:] + 1).tobytes()]


class Looked(dict):
    def __iter__(self):
        raise AssertionError("all old words are walked through for each slice")


def test_old_words_are_looked_up_and_not_walked_through(tokenizer):
    encoder = tokens.WordEncoder(tokenizer_file())
    encoder.old = Looked({"house": encoder.whole([" house"])[0]})
    ids, _ = encoder.encode(pa.array(["my house stands"]))
    assert np.array_equal(ids, reference(tokenizer, "my house stands")) and "house" in encoder.known


def test_lines_and_marks_share_the_ids_of_their_words(tokenizer):
    encoder = tokens.WordEncoder(tokenizer_file())
    texts = ["One house, one house.\nThe house!\n\nhouse stands\n", "house", "\nhouse.\nhouse,", "house.\n\n", "house.\n\n\nhouse", "house \n house"]
    ids, ends = encoder.encode(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == reference(tokenizer, text).tolist(), repr(text)
    # Words are learned once, whatever line or mark they stand at.
    assert {x for x, raw in encoder.known.items() if raw is not None} == {"One", "one", "house", "The", "stands"}
    assert set(encoder.bare) == {"One", "The", "house"}


# Packing


def best_fit_bins(lengths, capacity):
    """Number of bins and their contents by one-by-one best fit decreasing."""
    free = []
    for length in sorted(lengths, reverse=True):
        fit = [k for k, f in enumerate(free) if f >= length]
        if fit:
            free[min(fit, key=lambda k: free[k])] -= length
        else:
            free.append(capacity - length)
    return sorted(free)


@pytest.mark.parametrize("seed", range(25))
def test_histogram_packing_equals_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, rng.randint(1, capacity)) for _ in range(rng.randint(0, 300))]
    counts = {length: lengths.count(length) for length in set(lengths)}
    steps = packing.pack_histogram(counts, capacity)
    seen, used = {length: [] for length in counts}, {}
    for length, first, n, first_bin, each, offset in steps:
        for k in range(n):
            seen[length].append(first + k)
            used.setdefault(first_bin + k // each, []).append((offset + k % each * length, length))
    assert all(sorted(seen[length]) == list(range(n)) for length, n in counts.items())
    for content in used.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(length for _, length in content) for content in used.values()) == best_fit_bins(lengths, capacity)


def test_free_space_tree():
    rng = random.Random(0)
    space, free = packing.FreeSpace(50), []
    for k in range(400):
        if free and rng.random() < 0.5:
            x = rng.choice(free)
            free.remove(x)
            space.take(x)
        else:
            free.append(rng.randint(1, 50))
            space.add(free[-1], k, 1)
        for length in range(1, 51):
            assert space.tightest(length) == min((f for f in free if f >= length), default=None)


def test_packed_sequences(spark, tokenizer):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["word", "édition", "x1"], k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "ab " * 900, "same", "same"]
    got = packing.pack(document_frame(spark, texts), capacity=64).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc_id, pieces in by_doc.items():
        ids, pieces = reference(tokenizer, texts[doc_id]), sorted(pieces, key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes()
        assert all(r.length == 64 for r in pieces[1:]) and (len(ids) > 64 or len(pieces) == 1)
        assert all((r.start, r.ids_crc32) == (sum(p.length for p in pieces[: r.piece]), zlib.crc32(bytes(r.ids))) for r in pieces)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_bin) == len(best_fit_bins([r.length for r in got], 64))


def test_packing_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.length) for r in packing.pack(docs, with_ids=False).collect()) == [(-1, 1), (1, 3), (1, 3)]
    assert packing.pack(docs.limit(0)).count() == 0


def test_parts_ascend_with_ids_and_frequent_ids_fill_several(spark):
    rng = random.Random(2)
    ids = [7] * 4000 + [None] * 2000 + rng.sample(range(-5000, 5000), 2000)
    bounds = token_files.part_bounds(spark.createDataFrame([(i,) for i in ids], "doc_id long"), 40)
    assert len(bounds) == 39 and bounds == sorted(bounds)
    placed = [(i is not None, i or 0, token_files.part_of(bounds, i, rng.randrange(-(1 << 63), 1 << 63))) for i in ids]
    by_id = {}
    for given, i, part in placed:
        by_id.setdefault((given, i), []).append(part)
    spans = [(min(by_id[k]), max(by_id[k])) for k in sorted(by_id)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    sizes = np.bincount([part for *_, part in placed], minlength=40)
    assert sizes.max() < 500 and len(set(by_id[True, 7])) >= 15 and len(set(by_id[False, 0])) >= 7
    assert token_files.part_bounds(spark.createDataFrame([], "doc_id long"), 8) == [] and token_files.part_of([], 5, 0) == 0


def test_one_id_for_all_rows(spark, tokenizer):
    texts = odd_texts(12)[:120]
    got = token_files.token_table(document_frame(spark, texts, [3] * len(texts)), block_ids=40).orderBy("start").collect()
    assert sorted(bytes(r.ids) for r in got) == sorted(reference(tokenizer, t).tobytes() for t in texts)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
