"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers the text, turns look-alike letters and digits that stand for letters into
those, and makes one space of all between words. The lexicon is learned from labelled
documents, a sample of at most ``SAMPLE_DOCS`` in hash order: beginnings of words and whole
words, weighted by the log of how much oftener toxic documents have them, if that is
significant and nearly only toxic ones do. Exception phrases, given or learned (longer beginnings that clean documents
have rather than toxic ones), cancel the match they stand on. A document's matches, one per
place, are summed and normalised by its length; two coefficients and a constant, fitted on
the same sample, turn that into a score of 0 to 1. Ids, languages, sources and labels are
no inputs of a score.

The lexicon has at most ``LEXICON`` entries, so it is broadcast; documents are scored in one
scan without a shuffle.

Defined cases: null and empty texts have no matches and a score all the same; rows are
scored one by one, so repeats and null ids are kept; a null label is no label, and rows
that repeat a labelled id count as toxic if one does; without labelled rows of both kinds
the lexicon is empty and all scores are 0; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.words import bounded_batches, in_slices

SAMPLE_DOCS = 10_000
LEXICON = 2000
BEGINNINGS = range(3, 10)
LEAST_DOCS, LEAST_Z, LEAST_PART = 5, 2.8, 0.9
THRESHOLD = 0.3
HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"

# Letters of other scripts that look like Latin ones, and what they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ſ": "s",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_ALIKE = str.maketrans(
    LOOK_ALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(c): "" for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF)}
)
_STANDS_IN = re.compile(r"[0134578@$](?=[^\W\d_])|(?<=[^\W\d_])[013457]")
_BETWEEN = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words with one space around each."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = text.translate(_ALIKE)
    text = _STANDS_IN.sub(lambda m: SUBSTITUTES[m[0]], text)
    return f" {_BETWEEN.sub(' ', text).strip()} "


def patterns(folded: str) -> set[str]:
    """Beginnings of its words, and whole words with the space behind them."""
    found = set()
    for word in set(folded.split()):
        found.update(" " + word[:k] for k in BEGINNINGS if k < len(word))
        found.add(f" {word} ")
    return found


class Lexicon:
    """``weights`` by pattern; exceptions weigh ``-inf``. Patterns begin at a word."""

    def __init__(self, weights: dict[str, float]):
        self.machine = ahocorasick.Automaton()
        for pattern, weight in weights.items():
            self.machine.add_word(pattern, (len(pattern), weight))
        if weights:
            self.machine.make_automaton()
        self.empty = not weights

    def matched(self, text: str | None) -> tuple[float, int]:
        """Sum over places of the best weight there, and the number of words."""
        folded = fold(text)
        n = folded.count(" ") - 1
        if self.empty:
            return 0.0, n
        places: dict[int, float] = {}
        for end, (size, weight) in self.machine.iter(folded):
            at = end - size
            known = places.get(at, 0.0)
            places[at] = weight if weight < 0 else known if known < 0 else max(known, weight)
        return sum(w for w in places.values() if w > 0), n


def inputs(raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Constant, matches, and matches by length."""
    return np.stack((np.ones_like(raw), np.log1p(raw), np.log1p(1000 * raw / (n + 20))), -1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-6 * np.eye(len(b)), x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def sample(docs: DataFrame, labels: DataFrame, held_out: str, most: int) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled documents that are not held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(f"NOT ({held_out})")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def counted(rows: DataFrame) -> DataFrame:
    """``pattern, toxic, clean``: documents of either kind that have it, combined in the tasks."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                counts = Counter(), Counter()
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    counts[int(toxic == 1)].update(patterns(fold(text)))
                names = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([counts[1][p] for p in names], pa.int64()), pa.array([counts[0][p] for p in names], pa.int64())],
                    names=["pattern", "toxic", "clean"],
                )

    made = rows.mapInArrow(batches, "pattern string, toxic bigint, clean bigint")
    return made.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_weights(rows: DataFrame, exceptions: tuple[str, ...] = ()) -> dict[str, float]:
    """At most ``LEXICON`` patterns with weights, and exceptions on top of them."""
    totals = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    n_toxic, n_clean = totals[0] or 0, totals[1] or 0
    weights = {fold(p): -math.inf for p in exceptions}
    if not n_toxic or not n_clean:
        return weights
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    scored = counted(rows).withColumns({"odds": odds, "z": z})
    part = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    best = scored.filter((F.col("toxic") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & (part >= LEAST_PART))
    chosen = best.orderBy(F.desc("z"), F.length("pattern"), "pattern").limit(LEXICON).collect()
    kept: dict[str, float] = {}
    for row in chosen:
        # A longer pattern on top of a chosen beginning says nothing new.
        if not any(row.pattern[:k] in kept for k in range(1, len(row.pattern))):
            kept[row.pattern] = row.odds
    weights |= kept
    if kept:
        begins = F.array_contains(F.array(*(F.lit(p) for p in kept)), F.col("begin"))
        longer = scored.filter("clean >= 3 AND z <= -1").withColumn(
            "begin", F.explode(F.expr("transform(sequence(1, length(pattern) - 1), i -> left(pattern, i))"))
        )
        against = longer.filter(begins).groupBy("pattern").agg(F.max("clean").alias("clean"))
        weights |= {r.pattern: -math.inf for r in against.orderBy(F.desc("clean"), "pattern").limit(LEXICON).collect()}
    return weights


def train(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT, most: int = SAMPLE_DOCS, exceptions: tuple[str, ...] = ()) -> tuple[dict[str, float], list[float]]:
    """Weights, and the coefficients of ``inputs``."""
    bounded_batches(docs.sparkSession)
    rows = sample(docs, labels, held_out, most)
    weights = learn_weights(rows, exceptions)

    def match(batches):
        lexicon = Lexicon(weights)
        for batch in batches:
            found = [lexicon.matched(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), batch.column("toxic").cast(pa.int32())],
                names=["raw", "n", "toxic"],
            )

    # Three numbers for each document of the sample.
    told = rows.mapInArrow(match, "raw double, n bigint, toxic int").toPandas()
    y = (told["toxic"] == 1).to_numpy(float)
    if not len(y) or y.min() == y.max():
        return weights, []
    return weights, fit(inputs(told["raw"].to_numpy(float), told["n"].to_numpy(float)), y).tolist()


def scored(docs: DataFrame, weights: dict[str, float], coefficients: list[float]) -> DataFrame:
    """``doc_id, score`` of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    b = np.array(coefficients)

    def rows(batches):
        lexicon = Lexicon(weights)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw, n = lexicon.matched(text)
                z = float(inputs(np.float64(raw), np.float64(n)) @ b) if len(b) else -math.inf
                yield doc, 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    return docs.select("doc_id", "text").mapInArrow(lambda x: in_slices(rows(x), schema), "doc_id bigint, score double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``."""
    weights, coefficients = train(docs, labels)
    return scored(docs, weights, coefficients).select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, all columns as they are."""
    weights, coefficients = train(docs, labels)
    b = np.array(coefficients)

    def batches(found):
        lexicon = Lexicon(weights)
        for batch in found:
            keep = []
            for text in batch.column("text").to_pylist():
                raw, n = lexicon.matched(text)
                z = float(inputs(np.float64(raw), np.float64(n)) @ b) if len(b) else -math.inf
                keep.append(z < math.log(threshold / (1 - threshold)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
