"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import id_remainder, lean, prepared, widened

DIMENSIONS = 512
SEED = 17
#: Symbols: 0 for anything between letters, 1 to 26 for a to z, the others for other letters by code point.
SYMBOLS = 64
_OTHERS = SYMBOLS - 27
UNKNOWN = "und"
#: Languages that can be told apart at most: their profiles go to every worker.
MOST_LANGUAGES = 1000
_UNIT = 1_000_000
_LANGUAGES_TOGETHER = 64


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of every code point, by its lower-case form."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + low % _OTHERS
    return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Random vectors of +1 and -1 of the symbols."""
    return np.random.RandomState(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a text's symbol trigrams; no trigram if it has no letter."""
    symbols = _symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not symbols.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int64)
    symbols = symbols[np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))]
    return np.unique((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], return_counts=True)


def bound(codes: np.ndarray) -> np.ndarray:
    """A row for each trigram: its letters' vectors, permuted by their place, multiplied."""
    letters = _letters()
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


class _Bound:
    """The trigrams' vectors that a worker has met so far."""

    def __init__(self) -> None:
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.table = np.zeros((0, DIMENSIONS), np.int8)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        rows = self.row[codes]
        if (rows < 0).any():
            fresh = codes[rows < 0]
            self.row[fresh] = np.arange(len(self.table), len(self.table) + len(fresh))
            self.table = np.concatenate((self.table, bound(fresh)))
            rows = self.row[codes]
        return self.table[rows]


def weights(counts: np.ndarray) -> np.ndarray:
    """Weight of each trigram of a document: the root of its count, all squares together 1."""
    return np.sqrt(counts / max(1, counts.sum()))


def profiles(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from every row that has text and language.

    A prototype is the bundle of its documents' vectors. Each task bundles its own
    documents, in whole numbers; the bundles are added in Spark, and one of each
    language reaches the driver.
    """
    prepared(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def bundles() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                out, codes = np.zeros(DIMENSIONS, np.int64), np.flatnonzero(total)
                for at in range(0, len(codes), 4096):
                    out += total[codes[at : at + 4096]] @ bound(codes[at : at + 4096]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(out)], ["lang", "place", "value"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = grams(text)
                if len(codes):
                    if lang not in sums and len(sums) >= _LANGUAGES_TOGETHER:
                        yield from bundles()
                    sums.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))[codes] += np.rint(weights(counts) * _UNIT).astype(np.int64)
        yield from bundles()

    known = docs.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = known.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.limit((MOST_LANGUAGES + 1) * DIMENSIONS).toPandas()
    langs = sorted(found["lang"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = np.zeros((len(langs), DIMENSIONS))
    rows[found["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(dtype=int), found["place"].to_numpy(dtype=int)] = found["value"]
    return langs, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1)


def identify(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """docs with lang_pred and score (0 to 1): the language whose prototype has the largest cosine, the first by name of equals.

    Only rows for which `learn` holds are learned from. A text that is null or
    has no letter is `und` with score 0, as is every text if there is nothing to
    learn from. Columns of those two names are replaced. An empty table gives an
    empty table; rows that repeat count, and are answered, each.
    """
    langs, prototypes = profiles(docs.where(learn), text_column, lang_column)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_column)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Bound()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(at).to_pylist():
                codes, counts = grams(text or "")
                if not len(codes) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bundle = weights(counts).astype(np.float32) @ vectors[codes].astype(np.float32)
                cosines = prototypes @ (bundle / (np.linalg.norm(bundle) or 1))
                best = int(np.argmax(cosines))
                names.append(langs[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    chosen = docs.select(*kept)
    return chosen.mapInArrow(run, widened(chosen.schema, "lang_pred string, score double"))


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(id_remainder(id_column, 4) == 2, F.lit(False))
