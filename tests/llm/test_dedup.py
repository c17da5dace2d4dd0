"""SimHash and suffix-array dedup against brute force, and their odd cases."""

import hashlib
import itertools
import random

import pytest
import xxhash

from weftgraph.llm import simhash, suffixes
from weftgraph.llm.common import Scratch, connected_components


def roots(values, linked):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates_by_brute_force(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("ab Cd éf gh ij kl".split()) + str(rnd.randint(0, 99)) for _ in range(200)) for _ in range(6)]
    texts = [None, "", " \t", "one", "One", "two words"] + base + [b + " x" for b in base] + base[:2] + [b.replace("1", "9", 1) for b in base]
    rows = [(i * 7 + 3, t, 0) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()}
    value = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {i: found[i]["fingerprint"] for i in value} == {i: f"{v:016x}" for i, v in value.items()}
    want = roots(sorted(value), lambda a, b: (value[a] ^ value[b]).bit_count() <= 2)
    assert {i: found[i]["component_id"] for i in value} == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("tree_rows", [2048, 8])
def test_links_connect_what_is_near(spark, tree_rows):
    rnd, centre, values = random.Random(3), random.Random(2).getrandbits(64), set()
    for _ in range(300):
        v = centre
        for _ in range(rnd.randint(0, 4)):
            v ^= 1 << rnd.randint(0, 63)
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    scratch = Scratch(spark, "test")
    found = {r["node"]: r["component"] for r in connected_components(scratch, simhash.links(scratch, frame, tree_rows=tree_rows)).collect()}
    want = roots(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {v: found.get(v, v) for v in signed} == want


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        spans = sum(mark[i] and not (i and mark[i - 1]) for i in range(len(raw)))
        out[doc] = (len(raw), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(raw, mark) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_repeats_by_brute_force(spark, group_rows):
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("abcdé f") for _ in range(n)) for n in (90, 99, 100, 101, 140, 300)]
    rows = [(None, passages[5]), (-9, None), (-8, "")]
    for i in range(90):
        parts = [rnd.choice([rnd.choice(passages), "a" * rnd.randint(1, 250), "the of " * rnd.randint(1, 40), "".join(rnd.choice("abcdé f") for _ in range(rnd.randint(1, 200)))]) for _ in range(rnd.randint(0, 4))]
        rows.append((i * 1000 - rnd.randint(0, 999), "".join(parts)))
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n_bytes string")
    found = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(frame, with_text=False, group_rows=group_rows).collect()}
    assert found == brute_repeats(rows)


def test_kept_text_and_repeated_rows(spark):
    long = "é" * 80 + "xyz" * 40
    frame = spark.createDataFrame([(1, long), (1, long), (2, "q" + long)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["kept"]) for r in suffixes.remove_repeats(frame).collect())
    assert [k for k, _ in found] == [1, 1, 2] and found[2][1] == "q" and found[0] == found[1]
    assert suffixes.remove_repeats(frame.limit(0)).count() == 0
