"""Language and toxicity: what is learned holds on documents that were held out."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import langid, toxicity

LETTERS = {"aa": "etaoinshr", "bb": "uwkzyjxqv", "cc": "éàüßñöçlm"}


def made(spark, n=240):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        words = ["".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rnd.randint(0, len(words)), rnd.choice(["m0r0n", "MORON", "mоron", "scumbag"]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language_held_out(spark):
    docs = made(spark).select("doc_id", "text", "lang", F.lit("x").alias("score"))
    docs = docs.union(spark.createDataFrame([(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 !?", None, "x"), (None, "tea ohio", "bb", "x")], docs.schema))
    held = langid.held_out()
    rows = langid.identify(docs, ~held & F.col("doc_id").isNotNull()).withColumn("held", held).collect()
    assert len(rows) == 244
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "aa"]
    test = [r for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert test and sum(r["lang_pred"] == r["lang"] for r in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.identify(docs.where("doc_id = 1"), F.lit(False)).first()
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0.0)


def test_toxicity_held_out(spark):
    rows = made(spark)
    labels = rows.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    docs = rows.drop("toxic").union(spark.createDataFrame([(2000, None, "aa"), (2001, "", "aa")], "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in rows.collect()}
    test = [i for i in truth if found[i]["held_out"]]
    assert len(test) > 20 and sum(found[i]["predicted"] == truth[i] for i in test) >= 0.95 * len(test)
    assert found[2000]["predicted"] == 0 and found[2001]["predicted"] == 0
    none = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_exceptions_take_back_their_term():
    matcher = toxicity.Matcher({" trash ": 3.0, " trash bin ": -3.0})
    assert matcher.measures("the trash bin")[0] == 0 and matcher.measures("you Tr4sh!")[0] > 1
    matcher = toxicity.Matcher({" trash ": 3.0, " tras": 2.5, " trash bin ": -1.0, " the trash ": -1.0, " scum ": 4.0})
    assert matcher.measures("the trash bin")[0] == 0 and matcher.measures("")[0] == 0
    assert matcher.measures("the trash bin scum")[0] == math.log1p(4.0)
    assert matcher.measures("trash, the trash bin")[0] == math.log1p(5.5)


def test_matches_by_brute_force():
    rnd = random.Random(5)
    lexicon = {" ab ": 1.0, " ab": 0.5, " abc": 2.0, " ca ": 4.0, " ab ca ": -1.0, " ca ab ": -1.0, " b ca ": -1.0}
    matcher = toxicity.Matcher(lexicon)
    for _ in range(300):
        text = toxicity.folded(" ".join(rnd.choice(["ab", "ca", "abc", "b", "abcd"]) for _ in range(rnd.randint(0, 12))))
        at = {t: [i for i in range(len(text)) if text.startswith(t, i)] for t in lexicon}
        hidden = [(i, i + len(t)) for t, w in lexicon.items() if w < 0 for i in at[t]]
        want = sum(w for t, w in lexicon.items() if w > 0 for i in at[t] if not any(a <= i and i + len(t) <= b for a, b in hidden))
        assert matcher.total(text) == want


def test_prototypes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "_LANGUAGES_TOGETHER", 1)
    rows = [("tea ohio", "aa"), ("wuz jyx", "bb"), ("tea tea", "aa"), (None, "aa"), ("12", "bb"), ("x" * 5000, None)]
    langs, found = langid.profiles(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["aa", "bb"]
    for lang, row in zip(langs, found):
        want = sum(langid.weights(c) @ langid.bound(g).astype(float) for t, own in rows if own == lang and t for g, c in [langid.grams(t)] if len(g))
        assert abs(row - want / np.linalg.norm(want)).max() < 1e-4
