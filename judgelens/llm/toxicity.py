"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with evidence scores
sigmoid(bias + sum of its word values); a document scores by noisy-or with a
leak, 1 - (1 - leak) * prod(1 - sentence score), so one bad sentence is enough,
the sentences that carry the score are the offending ones, and length alone is
no evidence. The value of a word is the sum of the weights of its hashed features
(the word, its beginnings, its runs of four characters), so forms never seen
before get the value of their stem. Features take part if toxic documents have
them far more often than chance allows. Only document labels are needed: the
gradient of the noisy-or hands the blame to the sentences.

The model is fitted on at most ``MAX_PER_LABEL`` labelled documents of each
label of at most ``MAX_CHARS`` characters (documented bounds of the sample,
picked by a hash of the id); scoring reads every text whole. The weights are a
fixed ``2^HASH_BITS`` numbers.

Defined results: a text without evidence, also a null or empty one, scores the
leak; without labels of both kinds every score is the share of toxic labels, 0 if
there are none; repeated rows score alike; an empty table gives an empty result;
other columns are ignored. Labels that are null are left out; contradictory
labels of one document both count.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.llm.common import as_texts, field_type, map_batches, pick

MAX_PER_LABEL, MAX_CHARS = 2500, 20_000
HASH_BITS, ROUNDS, RATE, DECAY = 18, 250, 0.3, 1e-5
LEAST_DOCUMENTS, LEAST_DEVIATIONS = 4, 6.0  # toxic documents that have a feature, and how far above chance
THRESHOLD = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
MEMO = 400_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, its beginnings, its runs of four characters."""
    marked = f"<{word}>"
    names = {f"={word}"} | {f"^{word[:n]}" for n in range(3, min(len(word), 8))}
    names |= {marked[i : i + 4] for i in range(len(marked) - 3)}
    return sorted({zlib.crc32(x.encode()) & ((1 << HASH_BITS) - 1) for x in names})


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence; sentences without a word are left out."""
    return [words for part in SENTENCE.findall(text.lower()) if (words := WORD.findall(part))]


@dataclass
class Model:
    """Weights (positive where a feature takes part), bias of a sentence, hazard of the leak."""

    weights: np.ndarray
    bias: float
    leak: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def share(self, spark: SparkSession):
        """Broadcast the weights (2^HASH_BITS numbers); the result gives each worker process its own copy."""
        sent, own = spark.sparkContext.broadcast((self.weights, self.bias, self.leak)), []

        def model() -> Model:
            if not own:
                own.append(Model(*sent.value))
            return own[0]

        return model

    def word_value(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > MEMO:
                self.known.clear()
            value = self.known[word] = float(self.weights[features(word)].sum())
        return value

    def sentence_scores(self, bag: list[list[str]]) -> np.ndarray:
        """Score of each sentence, 0 without evidence."""
        value = self.word_value
        sums = np.array([sum(map(value, words)) for words in bag])
        return np.where(sums > 0, sigmoid(self.bias + sums), 0.0)

    def score(self, text: str | None) -> float:
        return self.combine(self.sentence_scores(sentences(text or "")))

    def combine(self, scores: np.ndarray) -> float:
        """Noisy-or of the leak and the sentences."""
        return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum() - self.leak))


def sigmoid(z):
    return np.exp(-np.logaddexp(0.0, -z))


def fit(texts: list[str], labels: list[int], importance: list[float] | None = None) -> Model:
    """Fit by full-batch Adagrad on the noisy-or likelihood of the document labels."""
    labels = np.array(labels, dtype=float)
    importance = np.ones(len(labels)) if importance is None else np.array(importance, dtype=float)
    share = float((importance * labels).sum() / importance.sum()) if len(labels) else 0.0
    size = 1 << HASH_BITS
    weights = np.zeros(size, np.float32)
    if not 0 < share < 1:
        return Model(weights, 0.0, float(-np.log1p(-min(share, 1 - 1e-12))))
    # Words by number, the distinct words of each document, and the features of each word, all flat.
    numbers: dict[str, int] = {}
    bags = [[[numbers.setdefault(w, len(numbers)) for w in words] for words in sentences(text)] for text in texts]
    flat, lengths = array("i"), array("i")
    for word in numbers:
        own = features(word)
        flat.extend(own)
        lengths.append(len(own))
    flat, lengths = np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    have, toxic = np.zeros(size), np.zeros(size)
    for bag, label, weight in zip(bags, labels, importance):
        words = np.unique([w for sentence in bag for w in sentence]).astype(np.int64)
        if len(words):
            own = np.unique(np.concatenate([flat[first[w] : first[w] + lengths[w]] for w in words]))
            have[own] += weight
            toxic[own] += weight * label
    expected = share * have
    far = (toxic - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    unit = importance[labels > 0].mean()
    chosen = (toxic >= LEAST_DOCUMENTS * unit) & (far >= LEAST_DEVIATIONS)
    # Pairs (word, feature slot) of chosen features; words and sentences without any are left out.
    owner = np.repeat(np.arange(len(lengths)), lengths)[chosen[flat]]
    used, slot = np.unique(flat[chosen[flat]], return_inverse=True)
    evident = np.zeros(len(numbers), bool)
    evident[owner] = True
    word_of, sentence_of, document_of = [], [], []
    for d, bag in enumerate(bags):
        for sentence in bag:
            words = [w for w in sentence if evident[w]]
            if words:
                word_of += words
                sentence_of += [len(document_of)] * len(words)
                document_of.append(d)
    word_of, sentence_of, document_of = (np.array(x, dtype=np.int64) for x in (word_of, sentence_of, document_of))
    n = len(texts)
    w, w_grown = np.full(len(used), 0.3), np.full(len(used), 1e-3)
    scalars, grown = np.array([-2.0, 0.02]), np.full(2, 1e-3)  # bias, leak
    for _ in range(ROUNDS):
        values = np.bincount(owner, weights=w[slot], minlength=len(numbers))
        z = scalars[0] + np.bincount(sentence_of, weights=values[word_of], minlength=len(document_of))
        hazard = scalars[1] + np.bincount(document_of, weights=np.logaddexp(0.0, z), minlength=n)
        # d loss / d hazard of a document; a sentence gets its share by sigmoid(z).
        blame = importance * np.where(labels > 0, -np.exp(-hazard) / np.maximum(-np.expm1(-hazard), 1e-12), 1.0)
        dz = blame[document_of] * sigmoid(z)
        dword = np.bincount(word_of, weights=dz[sentence_of], minlength=len(numbers))
        grad = np.bincount(slot, weights=dword[owner], minlength=len(used)) + DECAY * n * w
        w_grown += grad**2
        w = np.maximum(w - RATE * grad / np.sqrt(w_grown), 1e-6)
        both = np.array([dz.sum(), blame.sum()])
        grown += both**2
        scalars -= np.array([RATE, RATE / 10]) * both / np.sqrt(grown)
        scalars[1] = max(scalars[1], 1e-4)
    weights[used] = w
    return Model(weights, float(scalars[0]), float(scalars[1]))


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_label: int = MAX_PER_LABEL) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out part."""
    known = pick(labels, doc_id=id_col, label=label_col).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(*order).limit(max_per_label)
        sample = some if sample is None else sample.unionByName(some)
    # At most 2 * max_per_label ids.
    rows = (
        pick(docs, doc_id=id_col, text=text_col)
        .where(F.length("text") <= MAX_CHARS)
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "text", "label")
        .toPandas()
        .sort_values(["doc_id", "label", "text"])
    )
    got = rows["label"].value_counts().to_dict()
    # The labels keep their shares, however many of each were picked.
    weight = {label: totals.get(label, 0) / n for label, n in got.items()}
    mean = np.mean([weight[x] for x in rows["label"]]) if len(rows) else 1.0
    return fit(rows["text"].tolist(), rows["label"].tolist(), [weight[x] / mean for x in rows["label"]])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted, n_sentences, worst_sentence``."""
    shared = model.share(docs.sparkSession)

    def score(batch: pa.RecordBatch) -> pa.Table:
        own, scores, counts, worst = shared(), [], [], []
        for text in as_texts(batch.column("text")):
            bag = sentences(text)
            counts.append(len(bag))
            values = own.sentence_scores(bag)
            scores.append(own.combine(values))
            worst.append(int(values.argmax()) if bag and values.max() > 0 else None)
        return pa.table(
            {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                "n_sentences": pa.array(counts, pa.int64()),
                "worst_sentence": pa.array(worst, pa.int64()),
            }
        )

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    fields = [T.StructField("doc_id", field_type(docs, id_col)), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())]
    fields += [T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.LongType()), T.StructField("worst_sentence", T.LongType())]
    return map_batches(rows, score, T.StructType(fields))


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Offending sentences: ``doc_id, sentence, start, end, score``; characters of the text, end excluded."""
    shared = model.share(docs.sparkSession)

    def find(batch: pa.RecordBatch) -> pa.Table:
        rows, own = [], shared()
        for k, text in enumerate(as_texts(batch.column("text"))):
            number = 0
            for match in SENTENCE.finditer(text):
                words = WORD.findall(match.group().lower())
                if words:
                    value = float(own.sentence_scores([words])[0])
                    if value >= least:
                        rows.append((k, number, match.start(), match.end(), value))
                    number += 1
        columns = list(zip(*rows)) or [[]] * 5
        out = {"doc_id": batch.column("doc_id").take(pa.array(columns[0], pa.int64()))}
        out |= {n: pa.array(c, pa.int64()) for n, c in zip(("sentence", "start", "end"), columns[1:4])}
        return pa.table(out | {"score": pa.array(columns[4], pa.float64())})

    fields = [T.StructField("doc_id", field_type(docs, id_col)), *(T.StructField(n, T.LongType()) for n in ("sentence", "start", "end"))]
    return map_batches(pick(docs, doc_id=id_col, text=text_col), find, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def harmless_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    shared = model.share(docs.sparkSession)

    @F.pandas_udf("boolean")
    def harmless(texts: pd.Series) -> pd.Series:
        own = shared()
        return pd.Series([own.score(text) < THRESHOLD for text in texts], dtype=bool)

    return docs.where(harmless(F.col(f"`{text_col}`")))
