"""Near duplicates by SimHash: fingerprints of word shingles, linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import jaccard
from weftgraph.llm.common import Scratch, as_bytes, connected_components, free, lean, prepared
from weftgraph.session import broadcast_if_small

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints in one tree. Larger shards are cut by further bits.
TREE_ROWS = 2048
#: Numbers of rows that go, broadcast at most; of more, rows are shuffled.
BROADCAST_GONE = 1_000_000
_CHUNK = 1 << 16


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of UTF-8 bytes: a bit is set if it is set in over half the shingles' XXH64."""
    found = raw.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    return voted(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def voted(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 if there are none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        total += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long; a null text is empty."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_column).cast("long"), text_column).mapInArrow(run, "id long, fp long")


class LinkTree:
    """BK-tree over 64-bit values that keeps which values are linked at a radius.

    A node's children are keyed by their Hamming distance to it; a search
    follows only the edges whose key is within the radius of its own distance.
    A subtree that lies wholly in the searching value's component can add
    nothing, so it is skipped: tight groups don't cost the square of their size.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.above: list[int] = []
        self.parent: list[int] = []
        self.whole: list[int] = []
        self.refresh_at = 64

    def component(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _mark_whole(self) -> None:
        """For each node the component of its whole subtree, or -1 if there are several."""
        own = [self.component(i) for i in range(len(self.values))]
        whole = list(own)
        for i in range(len(whole) - 1, 0, -1):
            if whole[i] != own[self.above[i]]:
                whole[self.above[i]] = -1
        self.whole = whole

    def add(self, value: int) -> None:
        """Link value to every earlier value within the radius, then insert it."""
        new, radius, values, children, parent = len(self.values), self.radius, self.values, self.children, self.parent
        parent.append(new)
        if new == self.refresh_at:
            self._mark_whole()
            self.refresh_at *= 2
        whole, known = self.whole, len(self.whole)
        todo = [0] if new else []
        while todo:
            i = todo.pop()
            if i < known and whole[i] >= 0 and self.component(whole[i]) == self.component(new):
                continue
            apart = (values[i] ^ value).bit_count()
            if apart <= radius:
                one, other = self.component(i), self.component(new)
                parent[max(one, other)] = min(one, other)
            todo += [j for key, j in children[i].items() if apart - radius <= key <= apart + radius]
        at = last = 0
        while new and at is not None:
            if at < known and whole[at] >= 0 and self.component(whole[at]) != self.component(new):
                whole[at] = -1
            last, apart = at, (values[at] ^ value).bit_count()
            at = children[at].get(apart)
        if new:
            children[last][apart] = new
        values.append(value)
        children.append({})
        self.above.append(last)


def blocks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that add to one of bits known to be equal a block of the others, radius + 1 in all: values within the radius agree in one of them too."""
    left = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(len(left) * i / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << i for i in left[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lean
def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp), a shard's rows together: builds each shard's tree, yields (a, b) of its links as stars."""
    shard, held = None, []

    def stars() -> Iterator[tuple[int, int]]:
        if len(held) > 1:
            tree = LinkTree(radius)
            for fp in held:
                tree.add(fp & 0xFFFFFFFFFFFFFFFF)
            for i, fp in enumerate(held):
                if (c := tree.component(i)) != i:
                    yield held[c], fp

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        mask, value, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        pairs: list[tuple[int, int]] = []
        for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), len(fps)]):
            key = (mask[lo], value[lo])
            if key != shard:
                pairs += stars()
                shard, held = key, []
            held += fps[lo:hi].tolist()
        if pairs:
            yield out(pairs)
    if pairs := list(stars()):
        yield out(pairs)


def links(scratch: Scratch, values: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(a, b): links between the distinct 64-bit values of column fp, enough to connect all that differ in radius bits or fewer.

    Two values within the radius agree in one of radius + 1 blocks of their bits,
    so each value goes to one shard per block. The values of a shard of more than
    tree_rows agree in those bits, and so again in one block of the others: the
    shard is cut by these, as often as needed, and every shard gets a tree.
    Shards travel to their searches by a shuffle: a broadcast of all trees would
    grow with the corpus.
    """
    masks = [0]
    whole = values.select("fp", F.lit(0).cast("long").alias("mask"))
    found = None
    while True:
        inner = {m: blocks(m, radius) for m in masks}
        cut = F.create_map(*(x for m, own in inner.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*(F.lit(_signed(o)).cast("long") for o in own)))))
        shards = whole.select("fp", F.explode(cut[F.col("mask")]).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        masks = sorted({o for own in inner.values() for o in own})
        large = scratch.stored(shards.groupBy("mask", "value").count().where(F.col("count") > tree_rows).select("mask", "value"))
        last = large.isEmpty() or all(m.bit_count() >= 64 - radius for m in masks)
        cold = shards if last else shards.join(large, ["mask", "value"], "left_anti")
        new = cold.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(lambda it: _shard_links(it, radius), "a long, b long")
        found = new if found is None else found.unionByName(new)
        if last:
            return found
        whole = scratch.stored(shards.join(large, ["mask", "value"], "left_semi").select("fp", "mask"))


def components(scratch: Scratch, values: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(node, component) of the distinct values of column fp that have a link."""
    return scratch.stored(connected_components(scratch, links(scratch, values, radius, tree_rows)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, tree_rows: int = TREE_ROWS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, n_same.

    Fingerprints link at radius or fewer differing bits; component_id is the
    smallest id reachable over links. n_same is the number of rows that have the
    same fingerprint. Texts without words (null, empty, blank) have fingerprint
    zero and link like any other. Rows that repeat an id stay as rows of their
    own; a null id is never the smallest unless its component has no other. Other
    columns of docs are not looked at. An empty table gives an empty table.
    """
    spark = prepared(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    rows = scratch.stored(fingerprints(docs, id_column, text_column, words))
    nodes = scratch.stored(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n_same")))
    stars = components(scratch, nodes.select("fp"), radius, tree_rows)
    joined = nodes.join(stars, nodes.fp == stars.node, "left").select("fp", "first_id", "n_same", F.coalesce("component", "fp").alias("component"))
    roots = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(roots, "component").select("fp", "component_id", "n_same")
    return rows.join(named, "fp").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = jaccard.SHINGLE_WORDS) -> DataFrame:
    """One row of each component of near duplicates, with the columns of docs: that of the smallest id (of equal ids, of the smallest digest of the text).

    Texts are near duplicates if the Jaccard similarity of their shingles of so
    many words is four fifths or more; components are what such pairs link.
    Fingerprints of the same shingles, linked through the trees, give the first
    candidates; such pairs differ in up to twenty bits, so jaccard.components()
    finds all others, and confirms each. Of rows with the same text the one of
    the smallest id stays, then of the smallest other columns. A row with a null
    id stays only if its component has no other. Texts without words (null,
    empty, blank) are alike. An empty table gives an empty table.
    """
    scratch = Scratch(prepared(docs.sparkSession), "near")
    row, digest, place = (free(docs, n) for n in ("row", "digest", "place"))
    same = F.md5(F.coalesce(F.col(text_column), F.lit("")))  # equal texts, by 128 bits
    first = Window.partitionBy(digest).orderBy(F.col(id_column).asc_nulls_last(), *(F.col(c) for c in docs.columns if c not in (id_column, text_column)))
    once = docs.withColumn(digest, same).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    once = scratch.stored(once.select(*docs.columns, digest, F.monotonically_increasing_id().alias(row)))
    texts = once.select(F.col(row).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    roots = jaccard.components(scratch, texts, components, lambda hashes: _signed(voted(hashes)), words)
    keys = once.select(F.col(row).alias("row"), F.struct(F.col(id_column).isNull(), F.col(id_column), F.col(digest)).alias("key")).join(roots, "row")
    chosen = keys.groupBy("root").agg(F.min_by("row", "key").alias("chosen"), F.count("*").alias("n")).where("n > 1")
    gone = scratch.stored(roots.join(chosen, "root").where("row != chosen").select(F.col("row").alias(row)))
    return once.join(broadcast_if_small(gone, BROADCAST_GONE), row, "left_anti").select(*docs.columns)
