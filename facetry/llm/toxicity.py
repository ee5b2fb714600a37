"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents of letters that look like ASCII ones, and turns look-alike letters and
digits inside words into the letters they stand for, so that ``1d10t`` and a word in Cyrillic look-alikes
read as the plain word. The lexicon holds word beginnings with a weight each (the log ratio of how many
toxic and how many other documents use them, learnt in Spark from a bounded sample of labelled rows); a
match begins where a word begins. Exception phrases are matched by the same automaton and take back what
they cover. The weights of a text are summed, divided by the logarithm of its length, and turned into a
probability by a logistic curve with two numbers.

Rows of any kind: a null or empty text has no matches and the score of a text without any; labels of null
are not learnt; without labels of both kinds the lexicon is empty and all scores are 0; the longest of
several matches at one place counts; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.quality import held_out, labelled_sample

SAMPLE = 20_000
LEAST_DOCUMENTS = 5
LEAST_RATIO = 3.0
ENTRIES = 5_000
SHORTEST, LONGEST = 4, 12
THRESHOLD = 0.5

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһкмтвнαεορτυνικ", "aeopcyxijsdhkmtbhaeoptuvik", strict=True))
DIGITS = dict(zip("013457@$", "oieastas", strict=True))

#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "scum line", "pond scum", "stupid simple")

_FOLD = {ord(a): b for a, b in LOOK_ALIKE.items()}
_DIGIT = {ord(a): b for a, b in DIGITS.items()}


def _plain(letter: str) -> str:
    """The ASCII letter under accents, if there is one."""
    base = unicodedata.normalize("NFKD", letter)[:1]
    return base if "a" <= base <= "z" else letter


for _code in (*range(0x00E0, 0x0180), *range(0xFF41, 0xFF5B)):
    _FOLD.setdefault(_code, _plain(chr(_code)))

_FOLDED = np.arange(0x10000, dtype=np.uint32)
_FOLDED[list(_FOLD)] = [ord(x) for x in _FOLD.values()]


def _replace(text: str) -> str:
    """Look-alikes replaced by a table over all their letters at once."""
    if text.isascii():
        return text
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(codes < 0x10000, _FOLDED[codes & 0xFFFF], codes)
    return low.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def fold(text: str) -> str:
    """The text in lower case with look-alikes replaced, one space before each word; words of digits stay."""
    words = _replace(text.lower()).split()
    out = []
    for word in words:
        if not word.isascii() or not word.isalpha():
            if any("a" <= c <= "z" for c in word):
                word = word.translate(_DIGIT)
            word = word.strip("\"'“”«»¿¡()[]{}.,;:!?*#%&_-|~^<>/\\")
        out.append(word)
    return " " + " ".join(out) + " "


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases, and the two numbers of the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 0.0
    offset: float = -50.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(f" {term}", (len(term), weight))
            for phrase in self.exceptions:
                folded = fold(phrase).rstrip()
                found.add_word(folded, (len(folded) - 1, None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def weight_of(self, text: str | None) -> float:
        """The sum of the weights of all matches, divided by the logarithm of the text's length in words."""
        if not text or not len(self.automaton):
            return 0.0
        folded = fold(text)
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            begin = end - length + 1
            if weight is None:
                excused.append((begin, end))
            elif length > best.get(begin, (0, 0.0))[0]:
                best[begin] = (length, weight)
        if excused:
            best = {b: x for b, x in best.items() if not any(f <= b <= t for f, t in excused)}
        return sum(w for _, w in best.values()) / math.log(math.e + folded.count(" "))

    def score(self, text: str | None) -> float:
        x = self.slope * self.weight_of(text) + self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _term_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic and other documents of the sample each word beginning stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[dict, dict] = ({}, {})
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = set(fold(text.as_py() or "").split())
                terms = {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}
                into = counts[label.as_py() > 0]
                for term in terms:
                    into[term] = into.get(term, 0) + 1
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.record_batch(
                [
                    pa.array(terms, pa.string()),
                    pa.array([counts[1].get(t, 0) for t in terms], pa.int64()),
                    pa.array([counts[0].get(t, 0) for t in terms], pa.int64()),
                ],
                ["term", "toxic", "other"],
            )

    counted = sample.mapInArrow(count, "term string, toxic bigint, other bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn weights and curve from a bounded sample of labelled rows that are not held out."""
    rows = labelled_sample(docs, labels, label, sample)
    sizes = {bool(r[0]): r[1] for r in rows.groupBy(F.col("label") > 0).count().collect()}
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not other:
        return Lexicon({})
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    entries = (
        _term_counts(rows)
        .where(F.col("toxic") >= LEAST_DOCUMENTS)
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= LEAST_RATIO)
        # Long beginnings add nothing to a short one that is as telling.
        .orderBy(F.desc(F.col("ratio") * F.sqrt("toxic")), F.length("term"), "term")
        .limit(ENTRIES)
        .collect()
    )
    weights: dict[str, float] = {}
    for row in entries:
        if not any(row["term"][:n] in weights for n in range(SHORTEST, len(row["term"]))):
            weights[row["term"]] = row["ratio"]
    lexicon = Lexicon(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.weight_of(text.as_py()) for text in batch["text"]]
            yield pa.record_batch([pa.array(got, pa.float64()), batch["label"]], ["x", "y"])

    known = rows.mapInArrow(weigh, "x double, y double").toPandas().sort_values(["x", "y"])
    lexicon.slope, lexicon.offset = _logistic(known["x"].to_numpy(), (known["y"] > 0).to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with a small penalty on the slope."""
    at = np.array([1.0, -2.0])
    rows = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -50, 50)))
        gradient = rows.T @ (p - y) + np.array([0.1 * at[0], 0.0])
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag([0.1, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (0 or 1) of every document."""
    lexicon = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample=sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.value.score(text.as_py()) for text in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(got, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
