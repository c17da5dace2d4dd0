"""Parsing and linking of source: one small project in each language, and what must come out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import clusters as C
from weftgraph.operators.ids import dense_ids
from weftgraph.plans.call_graph import build_call_graph, build_catalog, build_versions, exported
from weftgraph.sources import other_source, python_source
from weftgraph.sources.files import file_table, scan
from weftgraph.sources.tables import changed_functions, flows

PYTHON = '''
import os
from math import floor as low

class Base:
    """A base."""
    def hello(self) -> str:
        return "x"

class Child(Base):
    def twice(self):
        return self.once() + super().hello()
    def once(self):
        def inner(n: int):
            return low(n)
        return inner(5)

async def later():
    pass

def main():
    obj = Child()
    obj.twice()
    print(os.sep)
'''
CPP = '''
#include <vector>
#include "util/helper.h"
// class Ghost { };
class Base { public: void baseMethod() { } };
class My : public Base, private ns::Mixin<int> {
public:
  void sayHello(const std::string& name) { print("call(x)"); }
};
int main() {
  My obj;
  obj.sayHello("a");
  auto* p = new My();
  return 0;
}
'''
ERLANG = '''-module(sample).
-import(lists, [map/2]).
say_hello(Name) -> io:format("hi ~s", [Name]).
kind(0) -> zero;
kind(N) when N > 0 -> plus.
main() ->
    say_hello("x"),
    spawn(sample, kind, [1]),
    X = case kind(1) of zero -> a; plus -> b end,
    X.
'''


def pairs(nodes, edges, key):
    names = {r[key]: r["combinedName"] for r in nodes.collect()}
    return sorted((names[r["source"]], names[r["target"]]) for r in edges.collect())


def test_python_rows():
    found = python_source.parse(PYTHON)
    of = lambda kind: [r for r in found if r["kind"] == kind]
    assert [(r["name"], r.get("origin"), r["as_name"]) for r in of("import")] == [("os", None, "os"), ("floor", "math", "low")]
    assert [(r["name"], r["bases"]) for r in of("class")] == [("Base", []), ("Child", ["Base"])]
    assert [(r["class"], r["name"]) for r in of("function")] == [("Base", "hello"), ("Child", "twice"), ("Child", "once"), ("Child", "inner"), ("Global", "main")]
    assert python_source.parse("def (")[0]["kind"] == "error"


def test_python_links(spark):
    found = spark.createDataFrame([("a/x.py", PYTHON), ("a/readme.md", "hi")], "path string, content string")
    nodes, edges, bronze = build_call_graph(found)
    assert pairs(nodes, edges, "fnc_id") == [("Child.twice", "Base.hello"), ("Child.twice", "Child.once"), ("main", "Child.twice")]
    everything, more, _ = build_call_graph(found, repo_functions_only=False)
    called = {b for _, b in pairs(everything, more, "fnc_id")}
    assert {"Child", "print", "Child.twice", "math.floor"} <= called
    assert bronze["errors"].count() == 0


def test_cpp_and_erlang_links(spark):
    found = spark.createDataFrame([("m.cpp", CPP), ("sample.erl", ERLANG)], "path string, content string")
    nodes, edges, bronze = build_call_graph(found, "cpp")
    assert [r["name"] for r in bronze["imports"].orderBy("imp_id").collect()] == ["vector", "util/helper.h"]
    assert {r["name"]: r["base_classes"] for r in bronze["classes"].collect()} == {"Base": [], "My": ["Base", "ns::Mixin"]}
    assert ("main", "My.sayHello") in pairs(nodes, edges, "fnc_id")
    nodes, edges, _ = build_call_graph(found, "erlang")
    found_pairs = set(pairs(nodes, edges, "fnc_id"))
    assert {("sample:main/0", "sample:say_hello/1"), ("sample:main/0", "sample:kind/1")} <= found_pairs


def test_flows(spark):
    nodes, edges = python_source.flow("def f(x):\n    if x:\n        return 1\n    for i in x:\n        g(i)\n    return 2")
    ends = {i for e in edges for i in e}
    assert ends <= {n[0] for n in nodes} and {k for _, _, k in nodes} >= {"Entry", "Exit", "Branch", "Merge"}
    nodes, edges = other_source.flow_erlang("f(X) -> case X of a -> g(X); _ when X > 1 -> h(X) end, done.")
    assert [n[1] for n in nodes][:4] == ["entry", "exit", "f(X)", "case X"] and "when X > 1" in [n[1] for n in nodes]
    functions = spark.createDataFrame([(7, "def f():\n    return 1"), (8, "not python (")], "fnc_id bigint, function_code string")
    found, links = flows(functions, "python")
    assert {r["func_id"] for r in found.collect()} == {7} and links.count() > 0


def test_catalog_keeps_its_references(spark):
    found = spark.createDataFrame([("a/x.py", PYTHON), ("a/b/y.py", "def f():\n    return main()"), ("setup.cfg", "[x]")], "path string, content string")
    catalog = build_catalog(found.withColumn("content", F.col("content").cast("binary")))
    ids = sorted(r["ID"] for r in catalog["function_nodes"].collect())
    assert ids == list(range(len(ids)))
    inside = {r["ID"] for r in catalog["subgraph_nodes"].collect()}
    assert all(r["source"] in inside and r["target"] in inside for r in catalog["subgraph_edges"].collect())
    assert [r["name"] for r in catalog["config_nodes"].collect()] == ["setup.cfg"]
    assert catalog["class_class_edges"].count() == 1
    nodes, edges = exported(catalog)
    known = {r["global_id"] for r in nodes.collect()}
    assert all(r["start_id"] in known and r["end_id"] in known for r in edges.collect())


def test_versions_chain(spark):
    commits = spark.createDataFrame([(f"c{i}", f"2024-01-0{i}", "n", "e", "l", "m") for i in range(1, 5)], "commit_sha string, authored_datetime string, author_name string, author_email string, author_login string, message string")
    bodies = ["def f():\n    return 1", "def f():\n    return 1  # same", "def f():\n    return 2", "def f():\n    return 1"]
    files = spark.createDataFrame([(f"c{i}", "x.py", "M", b) for i, b in enumerate(bodies, 1)], "commit_sha string, path string, status string, content string")
    nodes = spark.createDataFrame([(0, "x.py", "f")], "ID bigint, function_location string, combinedName string")
    found = build_versions(commits, files, nodes)
    assert [r["commit_sha"] for r in found["functionversion_nodes"].orderBy("ID").collect()] == ["c1", "c3", "c4"]
    assert sorted((r["source"], r["target"]) for r in found["functionversion_edges"].collect()) == [(0, 1), (1, 2)]
    assert [tuple(r) for r in found["functionversion_function_edges"].collect()] == [(2, 0)]


def test_changed_functions(spark):
    rows = [(1, "a.py", "modified", "def f():\n    return 1\ndef g():\n    return 1", "def f():\n    return 2\ndef g():\n    return 1"), (1, "b.py", "added", None, "def h(): pass")]
    found = changed_functions(spark.createDataFrame(rows, "number bigint, filename string, status string, base_content string, head_content string"))
    assert [tuple(r) for r in found.collect()] == [(1, "a.py", "f")]


def test_scan_and_folders(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("x = 1")
    (tmp_path / "a" / ".git" / "y").write_text("no")
    found = scan(spark, str(tmp_path))
    assert [r["path"] for r in found.collect()] == ["a/x.py"]
    table = {r["path"]: r for r in file_table(found).collect()}
    assert set(table) == {"", "a", "a/x.py"} and table["a/x.py"]["directory_id"] == table["a"]["file_id"]


def test_dense_ids_are_dense(spark):
    found = dense_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"], "ID", 5)
    assert sorted((r["k"], r["ID"]) for r in found.collect()) == [(i, i + 5) for i in range(1000)]


def test_assignment_and_linkage():
    rng = np.random.RandomState(1)
    from itertools import permutations

    for _ in range(20):
        cost = rng.randint(0, 20, (5, 5)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(5)))
        found = C.assignment(cost)
        assert sorted(found) == list(range(5)) and sum(cost[i, j] for i, j in enumerate(found)) == best
    near = np.kron(np.eye(2), np.ones((3, 3)))
    assert C.average_linkage(near, 2) == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("most", [4])
def test_cluster_names(spark, most):
    names = spark.createDataFrame([(n,) for n in ["readFile", "read_line", "readAll", "draw.circle", "drawSquare", "draw_line2"]], "name string")
    found = C.cluster_names(names, "name", most)
    assert found.count() == 6 and found.select("label").distinct().count() >= 2


def test_few_bytes_of_source_are_parsed_in_many_tasks_and_once(spark, tmp_path):
    from weftgraph.sources import registry, tables

    seen = str(tmp_path / "seen")

    def parse(source, path=""):
        from pyspark import TaskContext

        with open(seen, "a") as f:
            f.write(f"{TaskContext.get().partitionId()} {path}\n")
        return [{"kind": "function", "local_id": 0, "name": "f"}]

    registry.PARSERS["counted"] = parse
    try:
        files = spark.range(40).coalesce(1).select(F.format_string("src/p%d.x", "id").alias("path"), F.lit("").alias("content"))
        assert sorted(r[0] for r in tables.bronze(files, "counted")["functions"].select("fnc_id").collect()) == list(range(40))
    finally:
        del registry.PARSERS["counted"]
    lines = [x.split() for x in open(seen)]
    assert len(lines) == 40 and len({part for part, _ in lines}) > 1


def test_calls_without_a_typed_variable_do_not_meet_in_one_task(spark):
    from weftgraph.sources import tables

    files = spark.createDataFrame([(f"src/p{i}.py", f"class P:\n    def f{i}(self):\n        return self.f{i - 1}()\n") for i in range(300)], "path string, content string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tables.python_calls(tables.bronze(files, "python"))
        parts = [len(p) for p in found.select("combinedName").rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(parts) == 300 and max(parts) < 150
