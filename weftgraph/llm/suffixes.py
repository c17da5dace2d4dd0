"""Removal of repeated byte strings by prefix-free parsing.

Documents are cut into phrases at triggers of a rolling hash. The distinct
phrases are the dictionary; each document's sequence of phrases is its parse.
A dictionary phrase that has occurred before is repeated as a whole. Only
phrases whose trigger is shared by different phrases can also share single
strings. No suffix array is built: repeats have one length, so phrases are
grouped by hash, and of their strings of that length those whose rolling hash is
met twice are sorted by bytes and then by the parse's places, which say which
came first in the corpus. Groups too large for a task are settled by two hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import Scratch, as_bytes, lean, prepared, regrouped

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: Bytes of the rolling hash's window, a power of two.
WINDOW = 16
#: Phrases of one trigger and context that are compared in one task; the strings of larger groups are compared by their hashes over all tasks.
GROUP_ROWS = 20_000
_BASE, _OTHER_BASE = 0x100000001B3, 0x5851F42D4C957F2D
_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
#: Positions looked at together; the place within them takes the low bits of a trigger's key.
_SLICE_BITS = 22
_NO_ID = -(1 << 63)
_PHRASES = "h long, c long, doc long, at long, span int"
_ROWS_TOGETHER = 200_000


def _rolling(values: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of every run of so many values, by doubling."""
    level, size, power = values.astype(np.uint64), 1, base
    total, have = None, 0
    n = len(values) - length + 1
    while size <= length:
        if length & size:
            piece = level[have : have + n]
            total = piece if total is None else total * np.uint64(power) + piece
            have += size
        level = level[:-size] * np.uint64(power) + level[size:]
        size, power = size * 2, power * power & _ALL
    return total


def phrases(raw: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(start, stop, trigger place, trigger hash) of the phrases of one document.

    A string's trigger is the window in it with the smallest rolling hash, the
    leftmost of equals; a phrase is a maximal run of string starts [start, stop)
    with one trigger. So what a string's phrase is depends on its bytes alone.
    Fewer bytes than a string have no phrase.
    """
    starts, stops, places, hashes = [], [], [], []
    step = 1 << (_SLICE_BITS - 1)
    for base in range(0, len(raw) - length + 1, step):
        data = np.frombuffer(raw, np.uint8, min(step + length - 1, len(raw) - base), base)
        mixed = _rolling(data, window)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(_MIX)
        mixed ^= mixed >> np.uint64(32)
        key = mixed >> np.uint64(_SLICE_BITS) << np.uint64(_SLICE_BITS) | np.arange(len(mixed), dtype=np.uint64)
        least, have, want = key, 1, length - window + 1
        while 2 * have <= want:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if want > have:
            least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        start = np.concatenate((np.zeros(1, np.int64), cut))
        place = (least[start] & np.uint64((1 << _SLICE_BITS) - 1)).astype(np.int64)
        starts.append(start + base)
        stops.append(np.append(cut, len(least)) + base)
        places.append(place + base)
        hashes.append(mixed[place])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in (starts, stops, places, hashes))


def _merged(doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of byte runs (doc, at, size) as fewer runs; at holds the text's checksum above its low 32 bits."""
    if not len(doc):
        return doc, at, size
    order = np.lexsort((at, doc))
    doc, at, size = doc[order], at[order], size[order]
    group = np.concatenate((np.zeros(1, np.int64), np.cumsum((doc[1:] != doc[:-1]) | (at[1:] >> 32 != at[:-1] >> 32))))
    place = (group << 34) + (at & 0xFFFFFFFF)
    reach = np.maximum.accumulate(place + size)
    first = np.flatnonzero(np.concatenate(([True], place[1:] > reach[:-1])))
    last = np.append(first[1:], len(at)) - 1
    return doc[first], at[first], reach[last] - place[first]


def _table(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "c", "doc", "at", "span"])


def _mark_rows(doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows that say which bytes repeat: a negative span is their number."""
    doc, at, size = _merged(doc, at, size)
    spread = (doc.view(np.uint64) * np.uint64(_MIX)).view(np.int64)
    return _table(spread, np.zeros(len(doc), np.int64), doc, at, -size)


@lean
def _parse(batches: Iterator[pa.RecordBatch], length: int, window: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) -> their phrases (trigger hash h, content hash c, doc, at, span), those that repeat within a batch as marks already."""
    content = xxhash.xxh3_64_intdigest
    for batch in batches:
        hs, cs, docs, ats, spans = [], [], [], [], []
        for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            start, stop, place, h = phrases(raw, length, window)
            if not len(start):
                continue
            c = (content(raw[a:b]) for a, b in zip(start.tolist(), (stop + length - 1).tolist()))
            hs.append(h.view(np.int64))
            cs.append(np.fromiter(c, np.uint64, len(start)).view(np.int64))
            docs.append(np.full(len(start), doc, np.int64))
            ats.append(start + ((zlib.crc32(raw) & 0x7FFFFFFF) << 32))
            spans.append((stop - start) << 8 | place - start)
        if not hs:
            continue
        h, c, doc, at, span = map(np.concatenate, (hs, cs, docs, ats, spans))
        order = np.lexsort((at, doc, c, h))
        h, c, doc, at, span = h[order], c[order], doc[order], at[order], span[order]
        again = _again(h, c, doc, at)
        yield _mark_rows(doc[again], at[again], (span[again] >> 8) + length - 1)
        yield _table(h[~again], c[~again], doc[~again], at[~again], span[~again])


def _again(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows sorted by all four: whether a row has its (h, c) at a later place than the first of them."""
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return (doc != doc[first]) | (at != at[first])


@lean
def _dictionary(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by (h, c, doc, at), a trigger's together -> marks of repeated phrases, and the first places of those phrases whose trigger has other phrases too."""
    kept = [np.zeros(0, np.int64)] * 5  # of the trigger that may go on: the first row, and the first of its last phrase
    asked = False
    for batch in regrouped(batches, _ROWS_TOGETHER):
        rows = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
        said = rows[4] < 0
        if said.any():
            yield _table(*(x[said] for x in rows))
        before = len(kept[0])
        h, c, doc, at, span = (np.concatenate((x, y[~said])) for x, y in zip(kept, rows))
        if len(h) == before:
            continue
        again = _again(h, c, doc, at)
        yield _mark_rows(doc[again], at[again], (span[again] >> 8) + length - 1)
        lead = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))))
        trigger = np.concatenate((np.zeros(1, np.int64), np.cumsum(h[lead][1:] != h[lead][:-1])))
        several = np.bincount(trigger)[trigger] > 1
        wanted = lead[several & ~((lead < before) & asked)]
        yield _table(h[wanted], c[wanted], doc[wanted], at[wanted], span[wanted])
        last = lead[trigger == trigger[-1]]
        asked = len(last) > 1
        kept = [x[np.unique(last[[0, -1]])] for x in (h, c, doc, at, span)]


@lean
def _contexts(batches: Iterator[pa.RecordBatch], length: int, window: int) -> Iterator[pa.RecordBatch]:
    """(id, text, asked phrases) -> (key, doc, at, bytes) of each phrase's strings, by the trigger's left or right context.

    A string has half its other bytes or more on one side of its trigger, and
    equal strings have them equal there: the key is a hash of that half and the
    trigger. So what only shares a common trigger doesn't meet.
    """
    half = (length - window) // 2
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        keys, docs, ats, parts = [], [], [], []
        for doc, raw, asked in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            high = (zlib.crc32(raw) & 0x7FFFFFFF) << 32
            for one in asked:
                start, span = one["at"] & 0xFFFFFFFF, one["span"]
                stop, place = start + (span >> 8), start + (span & 0xFF)
                middle = min(max(place - half + 1, start), stop)  # strings from here on have half or more on the right
                for a, b, x, y in ((start, middle, place - half, place + window), (middle, stop, place, place + window + half)):
                    if a < b:
                        keys.append(digest(raw[x:y], seed=int(x < place)) - (1 << 63))
                        docs.append(doc)
                        ats.append(high + a)
                        parts.append(raw[a : b + length - 1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), pa.array(parts, pa.binary())], ["key", "doc", "at", "part"])


def _suffixes(doc: np.ndarray, at: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(doc, at, repeats, hash, other hash) of every string in the parts: whether an equal one is at an earlier place.

    Strings whose rolling hash is met once can't repeat. The others are sorted by
    their bytes, and within equal ones by place in the corpus.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    counts = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[row] + offset
    doc, at = doc[row], at[row] + offset
    hashes, others = _rolling(data, length)[start], _rolling(data, length, _OTHER_BASE)[start]
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    chosen = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    repeats = np.zeros(len(start), bool)
    if len(chosen):
        padded = -(-length // 8) * 8
        text = np.zeros((len(chosen), padded), np.uint8)
        text[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[start[chosen]]
        words = text.view(">u8").astype(np.uint64)
        ranked = np.lexsort((at[chosen], doc[chosen], *words.T[::-1]))
        words = words[ranked]
        new = np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1)))
        first = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
        place = chosen[ranked]
        repeats[place] = (doc[place] != doc[place[first]]) | (at[place] != at[place[first]])
    return doc, at, repeats, hashes, others


@lean
def _compared(batches: Iterator[pa.RecordBatch], length: int, group_rows: int) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by key, a key's together -> marks of the strings that repeat; of keys with more than group_rows phrases also every first string's hashes."""

    def judged(key: np.ndarray, doc: np.ndarray, at: np.ndarray, parts: list[bytes], open_group: bool) -> Iterator[pa.RecordBatch]:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        some = np.flatnonzero((size > 1) | open_group)
        if len(some):
            doc, at, repeats, one, other = _suffixes(doc[some], at[some], [parts[i] for i in some.tolist()], length)
            yield _mark_rows(doc[repeats], at[repeats], np.full(repeats.sum(), length))
            if open_group:
                rest = ~repeats
                yield _table(one[rest].view(np.int64), other[rest].view(np.int64), doc[rest], at[rest], np.zeros(rest.sum(), np.int64))

    held: pa.RecordBatch | None = None
    large: int | None = None  # the key whose phrases are more than fit
    step = max(1, min(group_rows, _ROWS_TOGETHER // 10))

    def parts_of(batch: pa.RecordBatch) -> tuple:
        return (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), batch.column(3).to_pylist())

    for batch in regrouped(batches, step):
        batch = batch if held is None else pa.concat_batches([held, batch])
        held = None
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if large is not None:
            n = int(np.searchsorted(key, large, "right"))
            if n:
                yield from judged(*parts_of(batch.slice(0, n)), True)
            batch, key = batch.slice(n), key[n:]
            if not len(key):
                continue
            large = None
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield from judged(*parts_of(batch.slice(0, last)), False)
        held = batch.slice(last)
        if held.num_rows > group_rows:
            yield from judged(*parts_of(held), True)
            large, held = int(key[-1]), None
    if held is not None:
        yield from judged(*parts_of(held), False)


def repeated_runs(docs: DataFrame, id_column: str, text_column: str, length: int = LENGTH, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc, crc, runs): for each document with repeated bytes its runs (start, size), as they were found, in any order."""
    spark = prepared(docs.sparkSession)
    scratch = Scratch(spark, "suffixes")
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_column).alias("text"))
    checked = texts.withColumn("crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).bitwiseAND(0x7FFFFFFF))
    parsed = texts.mapInArrow(lambda it: _parse(it, length, window), _PHRASES)
    found = scratch.stored(parsed.repartition("h").sortWithinPartitions("h", "c", "doc", "at").mapInArrow(lambda it: _dictionary(it, length), _PHRASES))
    asked = found.where("span >= 0").groupBy("doc", F.shiftright("at", 32).alias("crc")).agg(F.collect_list(F.struct("at", "span")).alias("asked"))
    parts = checked.join(asked, ["doc", "crc"]).select("doc", "text", "asked").mapInArrow(lambda it: _contexts(it, length, window), "key long, doc long, at long, part binary")
    more = scratch.stored(parts.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _compared(it, length, group_rows), _PHRASES))
    strings = more.where("span = 0")
    first = strings.groupBy("h", "c").agg(F.min(F.struct("doc", "at")).alias("first"))
    later = strings.join(first, ["h", "c"]).where(F.struct("doc", "at") != F.col("first")).select("doc", "at", F.lit(length).alias("size"))
    marks = found.where("span < 0").unionByName(more.where("span < 0")).select("doc", "at", (-F.col("span")).alias("size")).unionByName(later)
    runs = marks.groupBy("doc", F.shiftright("at", 32).alias("crc")).agg(F.collect_list(F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).alias("start"), "size")).alias("runs"))
    return runs


def _kept(raw: bytes, runs: list[dict] | None) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, what is left) of a document."""
    if not runs:
        return 0, 0, raw
    removed = count = end = 0
    left = []
    for start, size in sorted((r["start"], r["size"]) for r in runs):
        if start > end or not count:
            left.append(raw[end:start])
            count += 1
            end = start
        if start + size > end:
            removed += start + size - end
            end = start + size
    left.append(raw[end:])
    return removed, count, b"".join(left)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, with_text: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: n_bytes, n_removed, n_spans and kept_sha256 beside the id (with_text: beside all columns, and kept).

    Removed is each byte covered by a string of `length` bytes that also starts
    earlier: in a document of smaller id, or in the same one before. Strings are
    judged on the input. kept is what is left as text; where a removed run ends
    within a character, the rest of that character goes too, but kept_sha256 is
    of the exact bytes. Null texts count as empty, a null id comes before all
    others, rows that repeat an id are ordered by their text's checksum, and rows
    that repeat id and text are at one place, so neither repeats the other.
    Columns of docs that have a result's name are replaced. An empty table gives
    an empty table.
    """
    runs = repeated_runs(docs, id_column, text_column, length, group_rows=group_rows)
    new = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    if with_text:
        new = new.add("kept", T.StringType())
    names = [c for c in docs.columns if c not in new.names] if with_text else [id_column]
    raw = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.select(*(F.col(n).alias(f"_{i}") for i, n in enumerate(names)), raw.alias("text"), F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc"), F.crc32(raw.cast("binary")).bitwiseAND(0x7FFFFFFF).alias("crc"))
    joined = keyed.join(runs, ["doc", "crc"], "left").select(*(f"_{i}" for i in range(len(names))), "text", "runs")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        for batch in batches:
            raws = as_bytes(batch.column(n))
            found = [_kept(raw, spans) for raw, spans in zip(raws, batch.column(n + 1).to_pylist())]
            columns = [*batch.columns[:n], pa.array([len(r) for r in raws], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())]
            if with_text:
                columns.append(pa.array([f[2].decode("utf-8", "ignore") for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *new.names])

    return joined.mapInArrow(run, T.StructType([*docs.select(*names).schema.fields, *new.fields]))
