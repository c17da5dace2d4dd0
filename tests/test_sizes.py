"""What is dealt to tasks by its number of rows: the same results, in parts whose rows don't grow with the table."""

import random
from collections import Counter

import pytest

from weftgraph import session
from weftgraph.operators import clusters as C


@pytest.fixture()
def short_parts(monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 20)


def test_labels_are_found_in_parts_of_few_rows(spark, short_parts):
    rng = random.Random(7)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(400)]
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {n: n for n in near}
    for _ in range(3):
        want = {n: min(Counter(want[x] for x in near[n]).items(), key=lambda v: (-v[1], v[0]))[0] for n in near}
    found = C.label_propagation(spark.createDataFrame(pairs, "source bigint, target bigint"), 3)
    assert {r["node"]: r["label"] for r in found.collect()} == want
    assert len(found.inputFiles()) > 20  # of 4 parts of a shuffle otherwise


def test_authors_of_functions_are_found_in_parts_of_few_rows(spark, short_parts):
    from weftgraph.operators import edges as E

    people = spark.createDataFrame([(f"p{i:02d}", "", None) for i in range(10)], "login string, email string, name string")
    pulls = spark.createDataFrame([(i, f"p{i % 13:02d}") for i in range(100)], "ID bigint, author_login string")
    found = E.developer_tables(people, pulls, spark.createDataFrame([(i % 100, i % 7) for i in range(900)], "source bigint, target bigint"))[1]
    assert sorted(tuple(r) for r in found.collect()) == sorted({(i % 100 % 13 + 1, i % 7, i % 100) for i in range(900)})
    assert found.rdd.getNumPartitions() > 20


def test_subgraphs_are_numbered_in_parts_of_few_rows(spark, short_parts):
    from weftgraph.operators import linking as L

    nodes = [(f, n) for f in range(60) for n in range(0, 9) if (f * n) % 5 != 3]
    edges = [(f, n, n + 1) for f, n in nodes for _ in range(2)]
    numbered, found = L.filtered_subgraph(spark.createDataFrame(nodes, "func_id bigint, node_id bigint"), spark.createDataFrame(edges, "func_id bigint, source bigint, target bigint"))
    kept = sorted({(f, a, b) for f, a, b in edges if (f, b) in set(nodes)})
    ids = {k: i for i, k in enumerate(sorted({(f, x) for f, a, b in kept for x in (a, b)}))}
    assert {(r["func_id"], r["node_id"]): r["ID"] for r in numbered.collect()} == ids
    assert sorted(tuple(r) for r in found.collect()) == sorted((ids[f, a], ids[f, b], f) for f, a, b in kept)
    assert found.rdd.getNumPartitions() > 20
