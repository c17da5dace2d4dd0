"""The whole catalog of a made project, and its sinks."""

import pytest

from weftgraph.plans.knowledge import build_knowledge_graph, ensemble_inputs
from weftgraph.sources import sinks, snapshots


def test_whole_catalog(spark):
    made = lambda name, rows: spark.createDataFrame(rows, snapshots.SCHEMAS[name])
    code = "def f():\n    return g()\n\ndef g():\n    return 1\n"
    given = {
        "issues": made("issues", [(1, "bug", "b", "open", ["x"], [], None), (2, "old", "b", "closed", [], None, None)]),
        "pull_requests": made("pull_requests", [(7, "open", "fix", "fixes #1 and #99", "ann", None, [(1, "bo", None, None, "see #2")]), (8, "closed", "t", None, "cy", None, None)]),
        "pr_files": made("pr_files", [(7, "a.py", "modified", 1, 1, code.replace("1", "2"), code)]),
        "artifacts": made("artifacts", [(5, "log", 10, None, None)]),
        "contributors": made("contributors", [("ann", "a@x", None)]),
        "commits": made("commits", [("c1", "2024-01-01", "n", "e", "ann", "m")]),
        "commit_files": made("commit_files", [("c1", "a.py", "M", code)]),
    }
    files = spark.createDataFrame([("a.py", code)], "path string, content string")
    catalog = build_knowledge_graph(files, given, developer_mode="pr_authors", clusters=True)
    rows = lambda key: sorted(tuple(r) for r in catalog[key].collect())
    names = {r["ID"]: r["combinedName"] for r in catalog["function_nodes"].collect()}
    assert [(names[a], names[b]) for a, b in rows("function_edges")] == [("f", "g")]
    assert rows("issue_pr_edges") == [(1, 7), (2, 7)]
    assert [(a, names[b]) for a, b in rows("pr_function_edges")] == [(7, "g")]
    assert [(r[1], r[2]) for r in rows("developer_nodes")] == [("ann", "a@x"), ("cy", None)] and len(rows("developer_function_edges")) == 1
    assert len(rows("functionversion_nodes")) == 2 and len(rows("functionversion_function_edges")) == 2
    assert len(rows("question_cluster_edges")) == 4 * len(rows("cluster_nodes"))
    assert "[FUNCTION] f" in sinks.picture({k: v for k, v in catalog.items() if k in ("function_nodes", "function_edges")})
    assert set(sinks.tensor_tables(catalog)) >= {"function_x", "function__expression__edge_index"}
    with pytest.raises(ValueError):
        build_knowledge_graph(files, developer_mode="all")


def test_limits_and_workflows(spark):
    rows = [(n, "open" if n % 2 else "closed", "t", "b", "a", None, None) for n in range(10)]
    pulls = spark.createDataFrame(rows, snapshots.SCHEMAS["pull_requests"])
    done = spark.createDataFrame([(9,)], "number bigint")
    assert sorted(r["ID"] for r in snapshots.pull_nodes(pulls, 2, done).collect()) == [5, 6, 7, 8]
    assert snapshots.workflow("on:\n  push:\n    branches: [a]\n  pull_request:\njobs:\n  a:\n    runs-on: [linux, 'mac']\n    steps:\n      - uses: x/y@v1 # c") == (["pull_request", "push"], ["linux", "mac"], ["x/y@v1"])


def test_ensemble_inputs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 9), (7, 9)], "source bigint, target bigint")
    semantic = spark.createDataFrame([(n, 5 if n < 5 else 4) for n in (1, 2, 3, 7, 8, 9)], "func_id bigint, semantic bigint")
    assert all(r["semantic"] == r["community"] for r in ensemble_inputs(edges, semantic).collect())
