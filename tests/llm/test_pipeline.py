"""The pipeline's stages, each against a plain version on its own input."""

import collections
import importlib.util
import random

import numpy as np

import corpus_pipeline as pipeline
from weftgraph.llm import jaccard, packing

_here = importlib.util.spec_from_file_location("dedup_brute", __file__.replace("test_pipeline", "test_dedup"))
brute = importlib.util.module_from_spec(_here)
_here.loader.exec_module(brute)

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    rnd = random.Random(8)
    passage = " ".join(f"shared{i}" for i in range(30))
    rows = []
    for i in range(60):
        words = ["".join(rnd.choice("abcdefghij" if i % 2 else "klmnopqrst") for _ in range(5)) for _ in range(rnd.randint(20, 120))]
        text = " ".join(words[:10] + ([passage] if i % 5 == 0 else []) + words[10:])
        rows.append((i, text, "xx" if i % 2 else "yy", f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(100 + i, rows[i][1], "xx", "s0", 1) for i in range(5)]
    rows += [(200, None, "xx", "s0", 0), (201, "123 !?", "xx", None, 6), (202, "", None, "s1", 0), (3, rows[3][1], "xx", "s1", 1), (None, "ab cd ef gh", "xx", "s1", 1)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages(spark):
    docs = documents(spark)
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        after_frame = stage(spark, docs, "unused")
        after = after_frame.collect()
        if name != "packing":
            assert after_frame.columns == docs.columns
        if name == "language ID":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if r["doc_id"] not in (200, 201, 202))
        elif name == "SimHash near-dedup":
            value = {r["doc_id"]: brute.brute_fingerprint(r["text"]) for r in before if r["doc_id"] is not None}
            component = brute.roots(sorted(value), lambda a, b: (value[a] ^ value[b]).bit_count() <= 2)
            assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(i for i in value if component[i] == i)
        elif name == "suffix-array dedup":
            want = brute.brute_repeats([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"]: len((r["text"]).encode()) for r in after} == {i: n - gone for i, (n, gone, _, _) in want.items() if n > gone}
            assert any(gone for _, gone, _, _ in want.values())
        elif name == "mixing":
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)
            counts = collections.Counter(r["doc_id"] for r in after)
            assert max(counts.values()) <= 3
        else:
            words = packing.WordIds(packing.vocabulary())
            assert sum(r["length"] for r in after) == sum(len(words.ids(r["text"])) // 4 + 1 for r in before)
        docs = spark.createDataFrame(after, after_frame.schema)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_component(spark):
    def words(n):
        return " ".join(f"w{n}x{i}" for i in range(40))

    rows = [(None, words(i), "xx", "s", i) for i in range(5)] + [(None, words(1), "xx", "s", 9)]
    rows += [(7, words(10), "xx", "s", 0), (7, words(11), "xx", "s", 0), (8, words(11), "xx", "s", 0), (9, words(2), "xx", "s", 0), (7, words(10), "aa", "s", 0)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "unused").collect()
    want = [(None, words(i), "xx", i) for i in (0, 1, 3, 4)] + [(7, words(10), "aa", 0), (7, words(11), "xx", 0), (9, words(2), "xx", 0)]
    assert sorted((repr((r["doc_id"], r["text"], r["lang"], r["n_chars"])) for r in kept)) == sorted(map(repr, want))


def test_parity_loses_no_similar_pair(monkeypatch):
    rng = np.random.RandomState(1)
    pairs = []
    for _ in range(2000):
        both = rng.randint(0, 1 << 62, rng.randint(1, 300)).astype(np.uint64)
        pairs.append([np.unique(np.append(both, rng.randint(0, 1 << 62, rng.randint(0, len(both) // 3 + 1)).astype(np.uint64))) for _ in range(2)])
    similar = np.array([jaccard.similar(a, b) for a, b in pairs])
    sizes, bits = ([[of(p[i]) for p in pairs] for i in (0, 1)] for of in (len, jaccard.parity))
    n, m = map(np.array, sizes)
    may = jaccard.may_be_similar(n, m, *bits)
    assert similar.sum() > 200 and may[similar].all() and not may[~similar].all()
    monkeypatch.setattr(jaccard, "COMPARED_BYTES", 1000)  # a few pairs at a time
    assert (jaccard.may_be_similar(n, m, *bits) == may).all()
    monkeypatch.setattr(jaccard, "NARROW_BYTES", 32)
    narrow = jaccard.may_be_similar(n, m, *([jaccard.narrowed(x) for x in of] for of in bits))
    assert narrow[may].all() and max(map(len, map(jaccard.narrowed, bits[0]))) == 32
    assert jaccard.may_be_similar(n[:0], m[:0], [], []).shape == (0,)


def test_near_duplicates_by_jaccard(spark):
    rnd = random.Random(6)

    def edited(words, n):
        words = list(words)
        for i in rnd.sample(range(len(words)), n):
            words[i] = f"new{rnd.randint(0, 10**6)}"
        return words

    line = [f"line{i}" for i in range(8)]
    bases = [[f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(6, 150))] for _ in range(25)]
    texts = [b + line for b in bases] + [edited(b + line, rnd.randint(0, min(6, len(b)))) for b in bases for _ in range(3)]
    texts += [edited(bases[0] + line, 1) for _ in range(40)] + [["few", "words"], ["few", "words"], ["other"]]
    rows = [(i, " ".join(t), "xx", "s", 0) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    want = brute.roots(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "unused").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
    assert len(set(want.values())) < len(texts) - 20  # some are near copies
