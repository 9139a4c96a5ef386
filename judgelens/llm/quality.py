"""Quality rules by distribution divergence.

Two histograms of a text are held against references of the languages: classes
of characters, and common words of a language (one bin each, all other words in
one more). The Jensen-Shannon distance to the nearest language decides, and a
text too short for a histogram to mean something is not judged by it; the limit
falls with the length, as chance moves short histograms more. References are
counted in one pass over all documents that pass the plain rules and have few
symbols; they are a few hundred numbers, whatever the input.

Defined results: a null or empty text has no words and fails the plain rules; a
document of no given language still is held against all references; without any
reference (an empty table) the method has no objection; repeated rows get equal
verdicts; other columns are ignored, also those named like the results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.llm.common import as_bytes, field_type, map_batches, pick

# Common words by language; their shares are counted in the corpus.
COMMON_WORDS = {
    "en": "the of and to in is a that for it with as was on be are by this from or an at not have but they which you we can all their has more will".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux ont mais comme ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya".split(),
}
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "accented", "digit", "space", "line", "punctuation", "symbol", "other")
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
REFERENCE_WORDS_PER_SYMBOL = 10
# Guards: a histogram counts from this many bytes, or words, on.
GUARD_CHARS, GUARD_WORDS = 200, 80


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"))
    for name, members in (
        ("lower", range(97, 123)),
        ("upper", range(65, 91)),
        ("accented", range(0xC0, 0x100)),  # first byte of a character beyond ASCII; the other bytes count nowhere
        ("digit", range(48, 58)),
        ("space", b" \t\v\f"),
        ("line", b"\n\r"),
        ("punctuation", PUNCTUATION),
        ("symbol", SYMBOLS),
    ):
        out[list(members)] = CLASSES.index(name)
    out[0x80:0xC0] = -1
    return out


CLASS_OF_BYTE = _class_of_byte()
CONTINUATION = bytes(range(0x80, 0xC0))
SPACE = b" \t\n\v\f\r"


def char_histogram(raw: bytes) -> np.ndarray:
    """Characters per class."""
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(CLASS_OF_BYTE[CLASS_OF_BYTE >= 0], weights=by_byte[CLASS_OF_BYTE >= 0], minlength=len(CLASSES))


class CommonWords:
    """Bins of common words for each language; the last bin takes all other words."""

    def __init__(self, common: dict[str, list[str]]):
        self.languages = sorted(common)
        self.bins = {lang: {w.encode(): k for k, w in enumerate(dict.fromkeys(common[lang]))} for lang in self.languages}
        self.all = frozenset(w for bins in self.bins.values() for w in bins)

    def histogram(self, lang: str, counts: dict[bytes, int], n_words: int) -> np.ndarray:
        bins = self.bins[lang]
        out = np.zeros(len(bins) + 1)
        for word, n in counts.items():
            if word in bins:
                out[bins[word]] = n
        out[-1] = n_words - out.sum()
        return out

    def counts(self, words: list[bytes]) -> dict[bytes, int]:
        """Counts of the common words of any language; case and a trailing mark do not matter."""
        out: dict[bytes, int] = {}
        for word in words:
            if len(word) <= 6:
                word = word.rstrip(b".,;:!?").lower()
                if word in self.all:
                    out[word] = out.get(word, 0) + 1
        return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; 1 if one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / middle), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) == n:
        return 0
    base = len(numbers) + 1
    if base < 2_000_000:
        keys = (at[:-2] * base + at[1:-1]) * base + at[2:]
    else:  # the product would overflow: number the pairs first
        keys = np.unique(at[:-2] * base + at[1:-1], return_inverse=True)[1] * base + at[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.zeros(n + 1, dtype=np.int64)
    hit = np.flatnonzero(counts[inverse] > 1)
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + 3, -1)
    return int((np.cumsum(twice)[:n] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    r"""Lines (cut at \n) with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(raw: bytes) -> dict:
    """Counts of the plain rules."""
    words = raw.split()
    n, repeated = len(words), repeated_words(words)
    return {
        "words": words,
        "n_words": n,
        "word_chars": len(raw.translate(None, SPACE + CONTINUATION)),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": duplicate_lines(raw),
        "n_repeat_words": repeated,
        "base_failed": n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n,
    }


def typical(m: dict) -> bool:
    """Whether a document may shape the reference of its language."""
    return not m["base_failed"] and REFERENCE_WORDS_PER_SYMBOL * m["n_symbols"] <= m["n_words"]


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common=COMMON_WORDS) -> dict:
    """Histograms per language over all its typical documents."""
    bins = CommonWords(common)
    # Per language: first the character classes, then the word bins.
    width = {lang: len(CLASSES) + len(bins.bins[lang]) + 1 for lang in bins.languages}

    def count(batches):
        sums = {lang: np.zeros(width[lang]) for lang in bins.languages}
        for batch in batches:
            for raw, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                if lang in sums and typical(m := measure(raw)):
                    sums[lang] += np.concatenate([char_histogram(raw), bins.histogram(lang, bins.counts(m["words"]), m["n_words"])])
        rows = [(lang, k, v) for lang, x in sums.items() for k, v in enumerate(x.tolist()) if v]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "bin", "n"), map(list, zip(*rows)))))

    partial = pick(docs, text=text_col, lang=lang_col).mapInArrow(count, "lang string, bin long, n double")
    out = {lang: np.zeros(width[lang]) for lang in bins.languages}
    for row in partial.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():  # languages times bins
        out[row["lang"]][row["bin"]] = row["n"]
    return {lang: (x[: len(CLASSES)], x[len(CLASSES) :]) for lang, x in out.items() if x.sum()}


def distances(raw: bytes, m: dict, references: dict, bins: CommonWords) -> tuple[float | None, float | None]:
    """Distance of characters and of common words to the nearest language; None below the guards."""
    chars = words = None
    if references and len(raw) >= GUARD_CHARS:
        mine = char_histogram(raw)
        chars = min(js_distance(mine, ref[0]) for ref in references.values())
    if references and m["n_words"] >= GUARD_WORDS:
        counts = bins.counts(m["words"])
        words = min(js_distance(bins.histogram(lang, counts, m["n_words"]), ref[1]) for lang, ref in references.items())
    return chars, words


def accepts(n_words: int, chars: float | None, words: float | None) -> bool:
    """Whether the distances are usual for a text of this length."""
    noise = n_words**-0.5 if n_words else 1.0
    return (chars is None or chars <= max(0.18, 1.7 * noise)) and (words is None or words <= 0.16 + 1.6 * noise)


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common=COMMON_WORDS) -> DataFrame:
    """Per document the counts, ``base_failed, char_distance, word_distance, kept``."""
    references, bins = language_references(docs, text_col, lang_col, common), CommonWords(common)

    def judge(batch: pa.RecordBatch) -> pa.Table:
        raws = as_bytes(batch.column("text"))
        measures = [measure(raw) for raw in raws]
        found = [distances(raw, m, references, bins) for raw, m in zip(raws, measures)]
        return pa.table(
            {"doc_id": batch.column("doc_id")}
            | {name: pa.array([m[name] for m in measures], pa.int64()) for name in LONGS}
            | {
                "base_failed": pa.array([m["base_failed"] for m in measures], pa.bool_()),
                "char_distance": pa.array([d[0] for d in found], pa.float64()),
                "word_distance": pa.array([d[1] for d in found], pa.float64()),
                "kept": pa.array([not m["base_failed"] and accepts(m["n_words"], *d) for m, d in zip(measures, found)], pa.bool_()),
            }
        )

    fields = [T.StructField("doc_id", field_type(docs, id_col)), *(T.StructField(n, T.LongType()) for n in LONGS)]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_batches(pick(docs, doc_id=id_col, text=text_col), judge, T.StructType(fields))


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common=COMMON_WORDS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the same verdict as ``quality_report``."""
    references, bins = language_references(docs, text_col, lang_col, common), CommonWords(common)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            raw = (text or "").encode()
            m = measure(raw)
            out.append(not m["base_failed"] and accepts(m["n_words"], *distances(raw, m, references, bins)))
        return pd.Series(out, dtype=bool)

    return docs.where(passes(F.col(f"`{text_col}`")))
