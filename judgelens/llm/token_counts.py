"""Token counts by a linear longest-match automaton.

A word is cut greedily into the longest pieces of a vocabulary: first a piece
that may open a word, then pieces that may continue one. Instead of building
pieces, the automaton walks a trie over the bytes of the word once. Each node
knows how many pieces are complete when its string cannot be continued (the
popped count) and the node where the rest of the string goes on (the failure
link), so a word of n bytes takes at most 2n steps however often greedy matching
would have to go back. A word that cannot be cut counts as one unknown token.

Defined results: a null or empty text has no words and no tokens; words are runs
of anything but ASCII white space; a word of any length is walked whole; repeated
rows are counted each for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from judgelens.llm.common import as_bytes, field_type, map_batches, pick, tokenizer_file

UNKNOWN = -1


class LongestMatch:
    """Automaton over opening and continuing pieces (bytes); ``count`` gives the number of pieces of a word."""

    def __init__(self, opening: list[bytes], continuing: list[bytes]):
        # Nodes 0 and 1 are the empty opening and the empty continuing string; an edge is node * 256 + byte.
        self.edges: dict[int, int] = {}
        self.fail, self.popped, is_piece = [UNKNOWN, UNKNOWN], [0, 0], [False, False]
        order = []
        for root, pieces in ((0, opening), (1, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    child = self.edges.get(node * 256 + byte)
                    if child is None:
                        child = self.edges[node * 256 + byte] = len(self.fail)
                        self.fail.append(UNKNOWN)
                        self.popped.append(0)
                        is_piece.append(False)
                        order.append((child, node, byte))
                    node = child
                is_piece[node] = node > 1
        depth = [0] * len(self.fail)
        for child, node, _ in order:  # a parent is always made before its child
            depth[child] = depth[node] + 1
        for child, node, byte in sorted(order, key=lambda x: depth[x[0]]):
            if is_piece[child]:
                self.fail[child], self.popped[child] = 1, 1
                continue
            popped, at = self.popped[node], self.fail[node]
            while at != UNKNOWN and at * 256 + byte not in self.edges:
                popped += self.popped[at]
                at = self.fail[at]
            if at != UNKNOWN:
                self.fail[child], self.popped[child] = self.edges[at * 256 + byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy cut; ``UNKNOWN`` if there is none."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = pieces = 0
        for byte in word:
            child = edges.get(node * 256 + byte)
            while child is None:
                pieces += popped[node]
                node = fail[node]
                if node == UNKNOWN:
                    return UNKNOWN
                child = edges.get(node * 256 + byte)
            node = child
        while node > 1:
            pieces += popped[node]
            node = fail[node]
            if node == UNKNOWN:
                return UNKNOWN
        return pieces


def byte_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Opening and continuing pieces of a byte-level vocabulary file.

    Such a file writes bytes as printable characters and a leading space as a mark:
    pieces with it open a word. A word without an opening piece of its own opens
    with one that also continues words.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    pieces = [bytes(byte_of[c] for c in name) for name in names if all(c in byte_of for c in name)]
    marked = [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1]
    bare = [p for p in pieces if b" " not in p]
    single = [p for p in bare if len(p) == 1]
    return [*marked, *single], bare


class WordCounter:
    """Automaton with a bounded store of the words met; the store never changes a count."""

    def __init__(self, path: str, memo: int = 500_000):
        self.automaton, self.memo, self.known = LongestMatch(*byte_pieces(path)), memo, {}

    def count(self, words: list[bytes]) -> tuple[int, int]:
        """Tokens and unknown words; an unknown word is one token."""
        known = self.known
        if len(known) > self.memo:
            known = self.known = {}
        for word in set(words).difference(known):
            known[word] = self.automaton.count(word)
        counts = list(map(known.__getitem__, words))
        unknown = counts.count(UNKNOWN)
        return sum(counts) + 2 * unknown, unknown


_COUNTERS: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    """One counter per worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Per document: ``doc_id, n_words, n_tokens, n_unknown``."""
    path = tokenizer_file(vocabulary)

    def count(batch: pa.RecordBatch) -> pa.Table:
        words, tokens, unknown = [], [], []
        for raw in as_bytes(batch.column("text")):
            cut = raw.split()
            n, u = counter(path).count(cut)
            words.append(len(cut))
            tokens.append(n)
            unknown.append(u)
        longs = {n: pa.array(v, pa.int64()) for n, v in (("n_words", words), ("n_tokens", tokens), ("n_unknown", unknown))}
        return pa.table({"doc_id": batch.column("doc_id")} | longs)

    fields = [T.StructField("doc_id", field_type(docs, id_col)), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown"))]
    return map_batches(pick(docs, doc_id=id_col, text=text_col), count, T.StructType(fields))
