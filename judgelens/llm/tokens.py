"""Byte-level BPE ids of whole texts, a column at a time.

The pre-tokenizer of a byte-level vocabulary never lets a piece run from a
visible character over a single space into the next word, and it cuts around one
or two line feeds between visible characters, so a text may be cut there and the
cuts encoded apart. Words repeat: Arrow finds the distinct words of a slice of the
column and takes the marks off their ends, each worker keeps the ids of the stems
it met, and the tokenizers library sees only new stems, many at a time. Texts in
which a space touches other white space are encoded whole, as the rule does not
hold for them, and so are texts with more line feeds in a row and with the string of
an added token, such as "<|endoftext|>", which the library turns into that token's id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
ID = np.dtype("<u4")
SLICE_BYTES = 4 << 20
MARKS = ".,;:!?"


def ragged(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``source[start : start + length]`` behind each other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return source[:0]
    return source[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class WordEncoder:
    """Gives what ``Tokenizer.encode`` gives for each text, with an end id behind it.

    ``memo`` bounds the words kept in memory and never changes a result: when half
    of it is full, words that were not met since the last time are forgotten.
    """

    def __init__(self, path: str, memo: int = 1_100_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({token.content for token in self.tokenizer.get_added_tokens_decoder().values() if token.content})
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True
        self.memo, self.longest = memo, longest
        self.known: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.bare: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.line_feed = self.whole(["\n"])[0]
        self.line_feed_id = int(np.frombuffer(self.line_feed, dtype=ID)[0])

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=ID).tobytes() for x in found]

    def learn(self, stems: list[str]) -> None:
        """Ids of " stem" for each stem; None where a cut beside it would be wrong."""
        fit = [x for x in stems if x.isalpha() or (x and not x[0].isspace() and not x[-1].isspace())]
        if len(fit) < len(stems):
            self.known.update(dict.fromkeys(stems))
        self._joined(fit, " ", self.known)

    def _with_added(self, texts: pa.Array) -> pa.Array:
        """Which texts hold the string of an added token: a cut beside it could be wrong."""
        found = pa.array(np.zeros(len(texts), bool))
        for content in self.added:
            found = pc.or_(found, pc.match_substring(texts, content))
        return found

    def _uncut(self, texts: pa.Array) -> pa.Array:
        """Texts that are encoded whole from the start: those with the string of an added token, and with line feeds that are one piece."""
        uncut = self._with_added(texts)
        if pc.any(pc.match_substring(texts, "\n\n")).as_py():
            uncut = pc.or_(uncut, pc.or_(pc.match_substring(texts, "\n\n\n"), pc.ends_with(texts, "\n\n")))
        return uncut

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self.whole([marks])[0]
        return self.marks[marks]

    def _joined(self, stems: list[str], separator: str, into: dict[str, bytes | None], group: int = 2000) -> None:
        """Adds the ids of stems to ``into``, each behind a space (part of its first piece) or a line feed (a piece of its own)."""
        for i in range(0, len(stems), group):
            some = stems[i : i + group]
            raw = self.whole([separator + separator.join(some)])[0]
            ids = np.frombuffer(raw, dtype=ID)
            starts = np.flatnonzero(self.opens[ids] if separator == " " else ids == self.line_feed_id)
            if len(starts) != len(some):
                raise ValueError("the vocabulary does not mark the start of words")
            ends = [*(starts[1:] * ID.itemsize).tolist(), len(raw)]
            begins = ((starts + (separator != " ")) * ID.itemsize).tolist()
            into.update(zip(some, map(raw.__getitem__, map(slice, begins, ends))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids behind each other, and the place behind the last id of each text."""
        texts = texts.fill_null("")
        uncut = self._uncut(texts)
        # Each line feed becomes a word of its own, and an empty word shows that white space touches.
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(uncut, "", texts) if pc.any(uncut).as_py() else texts, "\n", " \n "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        word_of, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        first, n_texts, n_words, n_codes = offsets[:-1], len(texts), len(word_of), len(words)
        # The pre-tokenizer cuts between a letter and the marks behind it, so that many words share a stem.
        stems = pc.ascii_rtrim(words, MARKS)
        n_marks = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
        marked = (n_marks > 0) & pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, -1)).to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(marked), stems, words).to_numpy(zero_copy_only=False).tolist()
        ends = np.flatnonzero(marked)
        ends = dict(zip(ends.tolist(), (word[-n:] for word, n in zip(words.take(pa.array(ends)).to_numpy(zero_copy_only=False).tolist(), n_marks[ends].tolist()))))
        feed, empty = (pc.index(words, x).as_py() for x in ("\n", ""))
        if len(self.known) + len(self.bare) > self.memo // 2:
            self.old, self.known, self.bare = self.known, {}, {}
        # One look at each distinct word; only those without ids are looked at again.
        raws = list(map(self.known.get, stems))
        holes = [k for k, raw in enumerate(raws) if raw is None]
        missing = [stem for stem in dict.fromkeys(map(stems.__getitem__, holes)) if stem not in self.known]
        again = {stem: self.old[stem] for stem in missing if stem in self.old} if self.old else {}
        self.known.update(again)
        self.learn([stem for stem in missing if stem not in again] if again else missing)
        unfit = np.zeros(n_codes, bool)
        for k in holes:
            raws[k] = raw = self.known[stems[k]]
            if raw is None:
                unfit[k], raws[k] = True, b""
        for k, end in ends.items():
            raws[k] += self._mark(end)
        if feed >= 0:
            unfit[feed], raws[feed] = False, self.line_feed
        # A text is encoded whole if a cut in it would be wrong. An empty word is in place between line feeds and ends of the text.
        wrong = np.flatnonzero(unfit[word_of]) if unfit.any() else np.zeros(0, np.int64)
        after = np.zeros(n_words, bool)  # words without a space before them
        after[1:] = word_of[:-1] == feed
        after[first] = True
        if len(wrong):
            before = np.zeros(n_words, bool)
            before[:-1] = word_of[1:] == feed
            before[offsets[1:] - 1] = True
            wrong = wrong[(word_of[wrong] != empty) | ~after[wrong] | ~before[wrong]]
        text_of = np.repeat(np.arange(n_texts), np.diff(offsets))
        whole = uncut.to_numpy(zero_copy_only=False).copy()
        whole[text_of[wrong]] = True
        uncut = np.flatnonzero(whole)
        # Words without a space before them have ids of their own.
        after = np.flatnonzero(after & ~whole[text_of])
        is_bare = np.zeros(n_codes, bool)
        is_bare[word_of[after]] = True
        is_bare &= ~unfit
        if feed >= 0:
            is_bare[feed] = False
        bare = np.flatnonzero(is_bare)
        self._joined(list({stem for k in bare.tolist() if (stem := stems[k]) not in self.bare}), "\n", self.bare)
        bare_raws = [self.bare[stems[k]] + self._mark(ends.get(k, "")) for k in bare.tolist()]
        uncut_raws = self.whole(texts.take(pa.array(uncut)).to_pylist()) if len(uncut) else []
        for stem in missing:
            if len(stem) > self.longest:
                self.known.pop(stem, None)
                self.bare.pop(stem, None)
        raws += [*bare_raws, *uncut_raws, np.array([END_ID], dtype=ID).tobytes()]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // ID.itemsize
        starts = np.cumsum(sizes) - sizes
        # One place for each word and one more for the end id of each text.
        code_of = word_of.astype(np.int64)
        code_of[after] = np.where(is_bare[word_of[after]], n_codes + (np.cumsum(is_bare) - 1)[word_of[after]], word_of[after])
        sizes_here = sizes[code_of]
        if len(uncut):
            sizes_here[whole[text_of]] = 0
            code_of[first[uncut]] = n_codes + len(bare) + np.arange(len(uncut))
            sizes_here[first[uncut]] = sizes[code_of[first[uncut]]]
        at, last = np.arange(n_words) + text_of, offsets[1:] + np.arange(n_texts)
        begin, length = np.empty(n_words + n_texts, np.int64), np.empty(n_words + n_texts, np.int64)
        begin[at], length[at] = starts[code_of], sizes_here
        begin[last], length[last] = starts[-1], 1
        return ragged(np.frombuffer(b"".join(raws), dtype=ID), begin, length), np.cumsum(length)[last]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, with at least one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield start, end
        start = end


def encode_column(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of a text column: first row, ids of its texts behind each other, end of each text."""
    for start, end in slices(texts):
        ids, ends = encoder(path).encode(texts.slice(start, end - start))
        yield start, ids, ends
