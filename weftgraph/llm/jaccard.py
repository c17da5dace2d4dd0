"""Near duplicates by the Jaccard similarity of word shingles: every pair of at least four fifths.

SimHash finds the closest copies; it can't find all pairs this similar, whose
fingerprints differ in up to twenty bits. The rest is found by the prefix filter:
two sets that similar share one of their first shingles in any order common to
all. The order is by how many texts have a shingle, counted over all of them, so
that a text with enough shingles of its own never meets another one. It decides
the work, not the result. Shingles are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import BATCH_ROWS, Scratch, as_bytes, connected_components, lean
from weftgraph.session import broadcast_if_small

SHINGLE_WORDS = 5
SEED = 42
#: Texts whose numbers are broadcast at most, to pick them where they are read; of more, all texts are shuffled.
BROADCAST_TEXTS = 200_000
#: Characters a shingle takes, about; shingles of one bucket, about, and of one counter.
SHINGLE_CHARS, BUCKET_SHINGLES, SLOT_SHINGLES = 6, 1 << 20, 256
#: Bytes of texts that are looked at together, about.
CHUNK_BYTES = 1 << 21
#: Counters: at least and at most, and how many go into a row.
LEAST_SLOTS, MOST_SLOTS, SLOT_ROWS = 1 << 12, 1 << 22, 1 << 14
#: A shingle is frequent if its counter has so much, and so many times the mean of all counters.
FREQUENT, FREQUENT_TIMES = 1000, 4
#: Texts of one shingle that are compared in one task; more are compared block by block.
BLOCK_ROWS = 20_000
#: Bytes of a text's parities that go along with each of its shingles, and bytes of parities that are compared at once, about.
NARROW_BYTES, COMPARED_BYTES = 256, 1 << 23
#: Pairs of one task that are held until they are looked at.
HELD_PAIRS = 1 << 18
#: Texts of a shingle that all its others are compared with at first, whatever their number: the same for most shingles of a group of copies.
CENTRES = 8
_KNOWN_WORDS = 200_000
_TIMES = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_REFS, _SEEN = np.dtype("<u2"), np.dtype("<u2")


class _Words(dict):
    """Word -> hash, mixed, filled as words are met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, SEED)
        found = self[word] = h ^ h >> 29
        return found


class Shingler:
    """Sets of shingle hashes of many texts at once."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words, self.known = words, _Words()

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, sizes): of each text its distinct hashes, ascending, one text after another; fewer words are one shingle."""
        split = [raw.lower().split() for raw in raws]
        counts = np.array([len(s) for s in split], np.int64)
        known = self.known
        one = np.fromiter((known[w] for s in split for w in s), np.uint64, int(counts.sum()))
        n = len(one) - self.words + 1
        total = np.zeros(max(n, 0), np.uint64)
        for i in range(self.words if n > 0 else 0):
            total += one[i : i + n] * np.uint64(_TIMES[i])
        total = (total ^ (total >> np.uint64(32))) * _MIX
        out, at = [], 0
        for words, count in zip(split, counts.tolist()):
            if count >= self.words:
                out.append(np.unique(total[at : at + count - self.words + 1]))
            else:
                out.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64))
            at += count
        sizes = np.array([len(x) for x in out], np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(rows, texts) of a few texts at a time."""
    for batch in batches:
        rows, raws = batch.column(0).to_numpy(), as_bytes(batch.column(1))
        start = size = 0
        for i, raw in enumerate(raws):
            size += len(raw)
            if size >= CHUNK_BYTES or i + 1 == len(raws):
                yield rows[start : i + 1], raws[start : i + 1]
                start, size = i + 1, 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is four fifths or more; two empty sets are alike."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def parity(found: np.ndarray) -> bytes:
    """Bits, four to eight times as many as the set has members, each the parity of the members that fall on it."""
    width = 1 << max(3, len(found).bit_length() + 2)
    return np.packbits(np.bincount((found >> np.uint64(32) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes()


def _folded(a: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities, folded to so many bytes."""
    while a.shape[1] > width:
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    return a


def narrowed(bits: bytes) -> bytes:
    """A set's parities in NARROW_BYTES at most: a weaker bound, but still one."""
    return _folded(np.frombuffer(bits, np.uint8).reshape(1, -1), NARROW_BYTES).tobytes()


def may_be_similar(n: np.ndarray, m: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Of each pair of sets, their sizes and parities: false only if they aren't similar. Sets differ in at least as many members as their parities (folded to one width) do in bits."""
    out = np.zeros(len(n), bool)
    widths = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    for wa, wb in np.unique(widths, axis=0).tolist():
        same = np.flatnonzero((widths[:, 0] == wa) & (widths[:, 1] == wb))
        step = max(1, COMPARED_BYTES // (wa + wb))
        for at in (same[i : i + step] for i in range(0, len(same), step)):
            x, y = (np.frombuffer(b"".join([of[i] for i in at.tolist()]), np.uint8).reshape(len(at), w) for of, w in ((a, wa), (b, wb)))
            differ = np.bitwise_count(_folded(x, min(wa, wb)) ^ _folded(y, min(wa, wb))).sum(axis=1, dtype=np.int64)
            out[at] = 9 * differ <= n[at] + m[at]
    return out


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many of a set's first members one must be shared of."""
    return n - -(-4 * n // 5) + 1


def _split(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.flatnonzero(np.concatenate(([True], new))) if len(keys[0]) else np.zeros(0, np.int64)


def described(texts: DataFrame, slots: int, words: int, fingerprint: object) -> DataFrame:
    """(row, n, fp, bits) of each text (row, text), and then each task's counters of shingles as (slot, counts)."""
    names = ["row", "n", "fp", "bits", "slot", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    step = min(slots, SLOT_ROWS)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), np.zeros(slots, np.int64)
        for rows, raws in _chunks(batches):
            hashes, sizes = shingler(raws)
            counts += np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
            sets = _split(hashes, sizes)
            columns = [pa.array(rows), pa.array(sizes.astype(np.int32)), pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array([parity(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(sets), k) for k in kinds[4:])], names)
        at = [i for i in range(0, slots, step) if counts[i : i + step].any()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), k) for k in kinds[:4]), pa.array(at, pa.int32()), pa.array([counts[i : i + step].tobytes() for i in at], pa.binary())], names)

    return texts.mapInArrow(run, "row long, n int, fp long, bits binary, slot int, counts binary")


@lean
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters (slot, counts), those of a slot together, added up."""
    slot, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "counts"])

    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(c, np.int64)
            if s != slot:
                if slot is not None:
                    yield out()
                slot, total = s, c.copy()
            else:
                total += c
    if slot is not None:
        yield out()


#: A row holds what a group of texts (looked at together) has in a bucket of shingles: a text's place in its group, and the shingle's 32 bits below the bucket's.
#: Of a group without a bucket: its texts' numbers and sizes, and their frequent shingles.
_GROUPS = "bucket long, grp long, refs binary, shingles binary, seen binary, rows binary, sizes binary"
_GROUP_NAMES = [x.split()[0] for x in _GROUPS.split(", ")]
_GROUP_KINDS = [pa.int64(), pa.int64(), *[pa.binary()] * 5]


def _group_table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _GROUP_KINDS)], _GROUP_NAMES)


@lean
def _dealt(batches: Iterator[pa.RecordBatch], bits: int, words: int, counts: np.ndarray, frequent: int) -> Iterator[pa.RecordBatch]:
    """Texts (row, text) -> their shingles by bucket."""
    shingler, slots = Shingler(words), len(counts)
    for rows, raws in _chunks(batches):
        hashes, sizes = shingler(raws)
        refs = np.repeat(np.arange(len(rows)), sizes).astype(_REFS)
        seen = counts[(hashes & np.uint64(slots - 1)).astype(np.int64)]
        often = seen >= frequent
        tokens = hashes >> np.uint64(32 - bits)
        group = int(rows[0])
        out = [(None, group, refs[often].tobytes(), tokens[often].tobytes(), seen[often].tobytes(), rows.tobytes(), sizes.tobytes())]
        tokens, refs = tokens[~often], refs[~often]
        bucket = (tokens >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, tokens, refs = bucket[order], (tokens[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), refs[order]
        starts = _starts(bucket)
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist()):
            out.append((int(bucket[lo]), group, refs[lo:hi].tobytes(), tokens[lo:hi].tobytes(), None, None, None))
        yield _group_table(out)


@lean
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, a bucket's together -> by group the shingles that several texts have, and how many."""
    bucket: int | None = None
    held: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([np.frombuffer(h[2], "<u4") for h in held])
        refs = np.concatenate([np.frombuffer(h[1], _REFS) for h in held])
        group = np.repeat(np.arange(len(held)), [len(h[2]) // 4 for h in held])
        order = np.argsort(tokens, kind="stable")
        starts = _starts(tokens[order])
        size = np.diff(np.append(starts, len(order)))
        seen = np.repeat(size, size)
        order, seen = order[seen > 1], np.minimum(seen[seen > 1], 65535).astype(_SEEN)
        by = np.argsort(order, kind="stable")  # back in the order of groups
        order, seen = order[by], seen[by]
        group, tokens, refs = group[order], tokens[order], refs[order]
        starts = _starts(group)
        rows = [(bucket, held[group[lo]][0], refs[lo:hi].tobytes(), tokens[lo:hi].tobytes(), seen[lo:hi].tobytes(), None, None) for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(group)).tolist())]
        if rows:
            yield _group_table(rows)

    for batch in batches:
        own = batch.column(0).to_pylist()
        info = [i for i, b in enumerate(own) if b is None]
        if info:
            yield batch.take(pa.array(info, pa.int32()))
        for b, *row in zip(own, *(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if b is None:
                continue
            if held and b != bucket:
                yield from out()
                held = []
            bucket = b
            held.append(tuple(row))
    if held:
        yield from out()


@lean
def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, a group's together -> (token, row, n, at) of each text's first shingles that others have, at their place in its order."""
    group: int | None = None
    held: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        info = next(h for h in held if h[0] is None)
        rows, n = np.frombuffer(info[4], np.int64), np.frombuffer(info[5], np.int64)
        parts = [(np.frombuffer(info[1], _REFS), np.frombuffer(info[2], np.uint64), np.frombuffer(info[3], np.int64) + (1 << 32))]
        for bucket, refs, tokens, seen, _, _ in held:
            if bucket is not None:
                parts.append((np.frombuffer(refs, _REFS), np.frombuffer(tokens, "<u4").astype(np.uint64) | np.uint64(bucket << 32), np.frombuffer(seen, _SEEN).astype(np.int64)))
        refs, tokens, seen = (np.concatenate(x) for x in zip(*parts))
        refs = refs.astype(np.int64)
        own = n - np.bincount(refs, minlength=len(n))
        open_ = prefix_size(n) > own
        some = open_[refs]
        refs, tokens, seen = refs[some], tokens[some], seen[some]
        order = np.lexsort((tokens, seen, refs))
        refs, tokens = refs[order], tokens[order]
        at = own[refs] + np.arange(len(refs)) - np.searchsorted(refs, refs)
        first = at < prefix_size(n)[refs]
        refs, tokens, at = refs[first], tokens[first], at[first]
        if len(refs):
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(rows[refs]), pa.array(n[refs].astype(np.int32)), pa.array(at.astype(np.int32))], ["token", "row", "n", "at"])

    for batch in batches:
        for g, *row in zip(*(batch.column(i).to_pylist() for i in (1, 0, 2, 3, 4, 5, 6))):
            if held and g != group:
                yield from out()
                held = []
            group = g
            held.append(tuple(row))
    if held:
        yield from out()


def _keys_together(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first columns, cut only between their values."""
    held: list[pa.RecordBatch] = []
    last = None

    def columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(parts[0].num_columns))

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(_starts(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)))[-1])
        first, end = (tuple(batch.column(i)[at].as_py() for i in range(keys)) for at in (0, batch.num_rows - 1))
        if held and first == end == last:
            held.append(batch)
            continue
        parts = [*held, batch.slice(0, cut)]
        if sum(p.num_rows for p in parts):
            yield columns(parts)
        held, last = [batch.slice(cut)], end
    if held:
        yield columns(held)


def _pairs_of(a: list[np.ndarray], b: list[np.ndarray], row: np.ndarray, n: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """(a, b) of the places' rows, once each, but for those that their parities tell apart."""
    x, y = np.concatenate(a), np.concatenate(b)
    _, first = np.unique(np.sort(np.stack([row[x], row[y]], axis=1), axis=1), axis=0, return_index=True)
    x, y = x[first], y[first]
    may = may_be_similar(n[x], n[y], bits[x].tolist(), bits[y].tolist())
    x, y = row[x[may]], row[y[may]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


@lean
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs that share a token, are not in one component yet, and whose sizes, places and parities leave room for the similarity.

    Rows are (token, one block, other block, n, row, at, component, own block,
    narrowed parities) sorted by the first four.
    """
    for token, one, other, n, row, at, component, own, bits in _keys_together(batches, 3):
        starts = _starts(token, one, other)
        ends = np.append(starts[1:], len(token))
        a, b, held, n, left = [], [], 0, n.astype(np.int64), n.astype(np.int64) - at
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            last = lo + np.searchsorted(n[lo:hi], 5 * n[lo:hi] // 4, "right")
            two = one[lo] != other[lo]
            for i in range(lo, hi - 1):
                j = slice(i + 1, last[i - lo])
                fit = (component[j] != component[i]) & (9 * np.minimum(left[j], left[i]) >= 4 * (n[j] + n[i]))
                if two:
                    fit &= own[j] != own[i]
                if fit.any():
                    b.append(i + 1 + np.flatnonzero(fit))
                    a.append(np.full(len(b[-1]), i))
                    held += len(b[-1])
                    if held > HELD_PAIRS:
                        yield _pairs_of(a, b, row, n, bits)
                        a, b, held = [], [], 0
        if a:
            yield _pairs_of(a, b, row, n, bits)


@lean
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, size and parity of a, size and parity of b) that may be similar."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
        yield batch.select([0, 1]).filter(pa.array(may_be_similar(n, m, batch.column(3).to_pylist(), batch.column(5).to_pylist())))


@lean
def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, bits) with bits narrowed."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([narrowed(x) for x in batch.column(1).to_pylist()], pa.binary())], ["row", "bits"])


def rare_prefixes(scratch: Scratch, texts: DataFrame, sizes: DataFrame, counters: DataFrame, slots: int, words: int) -> DataFrame:
    """(token, row, n, at): the first shingles of each text, the rarest first, but for those that it alone has."""
    counts = np.zeros(slots, np.int64)
    added = counters.repartition("slot").sortWithinPartitions("slot").mapInArrow(_added, "slot int, counts binary")
    for r in added.collect():  # MOST_SLOTS numbers, whatever the input's size
        counts[r["slot"] : r["slot"] + SLOT_ROWS] = np.frombuffer(r["counts"], np.int64)
    total = int(counts.sum())
    frequent = max(FREQUENT, FREQUENT_TIMES * total // slots)
    bits = max(0, (total // BUCKET_SHINGLES).bit_length())
    known = scratch.spark.sparkContext.broadcast(counts)
    met = texts.mapInArrow(lambda it: _dealt(it, bits, words, known.value, frequent), _GROUPS)
    met = met.repartition(F.coalesce("bucket", F.xxhash64("grp"))).sortWithinPartitions("bucket").mapInArrow(_met, _GROUPS)
    return met.repartition("grp").sortWithinPartitions("grp").mapInArrow(_prefixes, "token long, row long, n int, at int")


def components(scratch: Scratch, texts: DataFrame, links_of: object, fingerprint: object, words: int = SHINGLE_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, root) of every text of (row, text), whose rows are numbers of their own: texts with the same root are linked by similar pairs.

    Candidates are first the texts that links_of() finds by their fingerprints,
    and each token's texts with a few of them, so that a group of near copies is
    mostly one component before all other pairs are looked at; pairs within a
    component are left out, which changes no component. All candidates are
    confirmed on their whole sets of shingles.
    """
    texts = texts.select("row", "text")
    assert BATCH_ROWS <= 1 << 16
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (chars // SHINGLE_CHARS // SLOT_SHINGLES).bit_length()))
    scanned = scratch.stored(described(texts, slots, words, fingerprint))
    sizes = scanned.where("row is not null").select("row", "n", "fp", "bits")
    early = scratch.stored(rare_prefixes(scratch, texts, sizes, scanned.where("row is null").select("slot", "counts"), slots, words))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        with_a = pairs.join(sizes.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
        with_b = with_a.join(sizes.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
        pairs = scratch.stored(with_b.select("a", "b", "na", "x", "nb", "y").mapInArrow(_possible, "a long, b long"))
        ends = broadcast_if_small(scratch.stored(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()), BROADCAST_TEXTS)
        have = scratch.stored(texts.join(ends, "row"))
        met = pairs.join(have.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(have.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(a, b) of the rows (a, b, text of a, text of b) that are similar."""
            shingler = Shingler(words)
            for batch in batches:
                one, other = (_split(*shingler(as_bytes(batch.column(i)))) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(list(map(similar, one, other)), pa.bool_()))

        found = scratch.stored(met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
        scratch.drop(have, pairs)
        return found

    by_print = links_of(scratch, sizes.where("n > 0").select("fp").distinct())
    joined = sizes.where("n > 0").join(by_print, sizes.fp == by_print.node, "left").select("row", F.coalesce("component", "fp").alias("c"))
    by_print = joined.join(joined.groupBy("c").agg(F.min("row").alias("low"), F.count("*").alias("k")).where("k > 1"), "c").select(F.col("low").alias("a"), F.col("row").alias("b"))
    centres = F.array_distinct(F.array(*(F.min_by("row", F.xxhash64("row", F.lit(i))) for i in range(CENTRES))))
    lists = scratch.stored(early.groupBy("token").agg(centres.alias("centres"), F.count("*").alias("k")).where("k > 1"))
    shared = early.join(lists, "token")
    links = confirmed(by_print.unionByName(shared.select(F.explode("centres").alias("a"), F.col("row").alias("b"))))
    near = scratch.stored(connected_components(scratch, links).withColumnRenamed("node", "row"))
    placed = scratch.stored(shared.join(near, "row", "left").select("token", "row", "n", "at", "k", F.coalesce("component", "row").alias("component")))
    open_ = scratch.stored(placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token"))
    blocks = F.expr(f"cast(ceil(k / {block_rows}) as int)")
    narrow = sizes.select("row", "bits").mapInArrow(_narrow, "row long, bits binary")
    cells = (
        placed.join(open_, "token").join(narrow, "row").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "n", "row", "at", "component", "own", "bits")
    )
    more = links.limit(0) if open_.isEmpty() else confirmed(cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "row").mapInArrow(_across, "a long, b long"))
    final = scratch.stored(connected_components(scratch, links.unionByName(more)).withColumnRenamed("node", "row"))
    empty = sizes.where("n = 0").agg(F.min("row")).first()[0]  # texts without words are alike
    root = F.when(F.col("n") == 0, F.lit(empty)).otherwise(F.coalesce("component", "row"))
    found = scratch.stored(sizes.join(final, "row", "left").select("row", root.alias("root")))
    scratch.drop(scanned, early, lists, links, near, placed, open_, more, final)
    return found
