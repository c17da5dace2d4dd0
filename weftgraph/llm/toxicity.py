"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import math
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, id_remainder, prepared, widened

#: Labelled rows of each class that are learned from at most: the first by a hash of the id.
SAMPLE_ROWS = 10_000
#: Documents of the toxic class a term must be in; the odds it must raise, as a logarithm.
LEAST_DOCS, LEAST_ODDS = 5, 2.5
PREFIXES = (4, 5, 6)

# Characters that look like a Latin letter, and digits and signs that stand for one.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ſ": "s",
}
_STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l"}
_FULL_WIDTH = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
#: Left out: what is written within a word to hide it, and has no width.
_INVISIBLE = dict.fromkeys("​‌‍⁠﻿­", "")
_FOLD = str.maketrans({c: " " for c in string.punctuation + "¡¿«»„“”‘’…–—"} | _LOOKALIKES | _STAND_INS | _FULL_WIDTH | _INVISIBLE)


def folded(text: str) -> str:
    """Lower case, look-alikes and stand-ins as letters, words between single spaces, one at each end."""
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


def features(text: str) -> set[str]:
    """A document's terms: its folded words, and prefixes of longer ones (with no space after)."""
    words = set(folded(text).split())
    return {f" {w} " for w in words if len(w) > 1} | {f" {w[:n]}" for n in PREFIXES for w in words if len(w) > n}


def _sketch(text: str) -> int:
    """The smallest hash of three words in a row: near copies mostly share it."""
    words = folded(text).split()
    rows = {" ".join(x) for x in zip(words, words[1:], words[2:])} or {" ".join(words)}
    return min(xxhash.xxh64_intdigest(w, 1) for w in rows) >> 1


class Matcher:
    """Total weight of a text's lexicon matches, but for those that stand within an exception phrase (a term of negative weight)."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term), weight))
        if lexicon:
            self.automaton.make_automaton()
        self.empty = not lexicon

    def total(self, text: str) -> float:
        """Of a folded text."""
        terms, phrases = [], []
        for last, (size, weight) in self.automaton.iter(text):
            (phrases if weight < 0 else terms).append((last + 1 - size, last + 1, weight))
        if not phrases:
            return sum(weight for _, _, weight in terms)
        phrases.sort()
        starts = [p[0] for p in phrases]
        reach = list(accumulate((p[1] for p in phrases), max))  # the furthest end of the phrases that begin so early
        return sum(weight for start, end, weight in terms if not (at := bisect_right(starts, start)) or reach[at - 1] < end)

    def measures(self, text: str) -> tuple[float, float]:
        """(total weight, weight for each word), as logarithms of one more."""
        if self.empty:
            return 0.0, 0.0
        text = folded(text)
        total = self.total(text)
        return math.log1p(total), math.log1p(100 * total / (text.count(" ") or 1))


def _counted(sample: DataFrame, of: object) -> DataFrame:
    """(term, toxic, clean): how many documents of each class have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(of(text or ""))
        terms = [*(counts[0].keys() | counts[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    counted = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression with an intercept by Newton's method, slightly ridged."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[float]]:
    """(lexicon with exception phrases, logistic weights) from labelled documents for which `allowed` holds.

    The sample is bounded (sample_rows of each class); near copies in it count
    once. A term's weight is the logarithm of the odds it raises. A phrase of a
    term and a neighbouring word that is as common in clean texts is an exception:
    no term within it counts. All that the bounded sample shows is kept.
    """
    scratch = Scratch(prepared(docs.sparkSession), "toxicity")
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(F.col("id").isNotNull() & allowed)
    order = F.xxhash64("id")
    sample = known.where("toxic = 1").orderBy(order, "id").limit(sample_rows).unionByName(known.where("toxic = 0").orderBy(order, "id").limit(sample_rows))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(sample.distinct()), "id")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sketch(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["id", "text", "toxic", "sketch"])

    kept = scratch.stored(texts.select("id", "text", "toxic").mapInArrow(sketched, "id long, text string, toxic int, sketch long"))
    firsts = kept.groupBy("sketch", "toxic").agg(F.min("id").alias("id")).select("id", "toxic")
    once = scratch.stored(kept.join(firsts, ["id", "toxic"], "left_semi").select("id", "text", "toxic").repartition(24, "id"))
    classes = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return {}, [-5.0, 0.0, 0.0]

    weight = F.log((F.col("toxic") + 0.5) / (classes[1] + 1)) - F.log((F.col("clean") + 0.5) / (classes[0] + 1))
    strong = _counted(once, features).withColumn("weight", weight).where((F.col("toxic") >= LEAST_DOCS) & (F.col("weight") >= LEAST_ODDS))
    lexicon = {r["term"]: r["weight"] for r in strong.orderBy("term").collect()}  # as many as the sample gives

    def phrases(text: str) -> set[str]:
        words = folded(text).split()
        found = set()
        for i, word in enumerate(words):
            if f" {word} " in lexicon or any(len(word) > n and f" {word[:n]}" in lexicon for n in PREFIXES):
                found |= {f" {a} {b} " for a, b in ((words[i - 1] if i else "", word), (word, words[i + 1] if i + 1 < len(words) else "")) if a and b}
        return found

    for r in _counted(once, phrases).withColumn("weight", weight).where((F.col("clean") >= LEAST_DOCS) & (F.col("weight") <= 0)).orderBy("term").collect():
        lexicon[r["term"]] = -1.0
    matcher = Matcher(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(lexicon)
        for batch in batches:
            both = [own.measures(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([b[i] for b in both], pa.float64()) for i in (0, 1)), batch.column(2)], ["toxic", "total", "each", "id"])

    rows = once.select("text", "toxic", "id").mapInArrow(measured, "toxic int, total double, each double, id long").orderBy("id").toPandas()
    return ({} if matcher.empty else lexicon), [float(x) for x in _logistic(rows[["total", "each"]].to_numpy(), rows["toxic"].to_numpy())]


def score(docs: DataFrame, lexicon: dict[str, float], fitted: list[float], text_column: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts are scored as having no match."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = []
            for text in batch.column(at).to_pylist():
                total, each = matcher.measures(text or "")
                found.append(1 / (1 + math.exp(-max(-50.0, min(50.0, fitted[0] + fitted[1] * total + fitted[2] * each)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], [*kept, "score", "predicted"])

    chosen = docs.select(*kept)
    return chosen.mapInArrow(run, widened(chosen.schema, "score double, predicted int"))


def held_out(id_column: str = "doc_id") -> Column:
    """Documents whose label is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(id_remainder(id_column, 5) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Learns from labels of rows that aren't held out (a null id isn't learned
    from), then scores every whole text. Rows that repeat are scored each; an
    empty table gives an empty table; without labels of both classes every score
    is the same low one. Other columns are never looked at.
    """
    lexicon, fitted = learn(docs, labels, ~held_out("id"), id_column, text_column)
    plain = docs.select(F.col(id_column).alias(id_column), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    return score(plain, lexicon, fitted).drop("text")
