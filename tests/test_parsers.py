"""C++ declarators, scopes and chains, Python declarations and finally blocks, each by what must come out."""

import time

import pytest

from weftgraph.plans.call_graph import build_call_graph
from weftgraph.sources import python_source
from weftgraph.sources.cpp_source import parse_cpp

CPP = """
template <typename T, class U = std::vector<int>> class Box : public Base<T, U>, Mixin { public: T get() const { return v_; } T v_; };
struct A {
  A() : x(0), y{1} { init(); }
  int h(map<int,int> m, int (*cb)(int));
  void operator()(int z) { go(z); }
  bool operator==(const A& o) const { return true; }
  void init() { }
};
int A::h(map<int,int> m, int (*cb)(int)) {
  { Box b; b.get(); }
  if (cb) { auto q = [](int v) { return inner(v); }; }
  return b.get();
}
namespace n { static inline const std::string& name(const A& a, int k = 3, void* q) { for (auto& e : a.list) { e.run(); } return a.name(); } }
enum class E { X, Y };
"""
CHAIN = """
struct Inner { void last() { } };
struct Middle { Inner* inner() { return p; } };
struct Outer { Middle& middle() { return m; } void self() { middle(); this->middle(); } };
void run(Outer& o, std::unique_ptr<Middle> u) {
  o.middle().inner()->last();
  u->inner();
  { Inner o; o.last(); }
}
"""


def test_cpp_declarators():
    rows = parse_cpp(CPP)
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    assert [(r["name"], r["bases"]) for r in of("class")] == [("Box", ["Base", "Mixin"]), ("A", [])]
    assert [(r["class"], r["name"]) for r in of("function")] == [("Box", "get"), ("A", "A"), ("A", "operator()"), ("A", "operator=="), ("A", "init"), ("A", "h"), ("Global", "name")]
    named = {r["name"]: r for r in of("function")}
    assert named["h"]["params"] == {"m": "map<int,int>", "cb": "int (*)(int)"} and named["h"]["return_type"] == "int"
    assert named["name"]["params"] == {"a": "const A &", "k": "int", "q": "void *"} and named["name"]["return_type"] == "const std::string&"
    assert [(c["func_name"], c["name"]) for c in of("call")] == [("A", "init"), ("operator()", "go"), ("h", "b.get"), ("h", "inner"), ("h", "b.get"), ("name", "e.run"), ("name", "a.name")]
    b = named["h"]["local_vars"][0]
    inside, outside = (c["position"] for c in of("call") if c["name"] == "b.get")
    assert b["name"] == "b" and b["start"] <= inside <= b["end"] < outside


@pytest.mark.parametrize("unit", ["{", "(", "a::", "<", "};", "a<b,", "void f(int a) { A x; x.g(a); }\n", "f(x) :", '"', "/*"])
def test_cpp_scan_is_linear(unit):
    began = time.time()
    parse_cpp(unit * (200_000 // len(unit)))
    assert time.time() - began < 8


def test_cpp_chains(spark):
    files = spark.createDataFrame([("m.cpp", CHAIN)], "path string, content string")
    nodes, edges, _ = build_call_graph(files, "cpp")
    names = {r["fnc_id"]: r["combinedName"] for r in nodes.collect()}
    found = sorted((names[r["source"]], names[r["target"]]) for r in edges.collect())
    # The first call of the chain is there twice: as the inner call, and as the chain's first step.
    assert found == sorted([("run", "Outer.middle")] * 2 + [("run", "Middle.inner")] * 2 + [("run", "Inner.last")] * 2 + [("Outer.self", "Outer.middle")] * 2)


def test_python_declarations():
    rows = python_source.parse_declarations("import a.b as c\nclass X(Y):\n    @staticmethod\n    async def f(p, /, q: int, *r, s=1) -> str:\n        'd'\n        return g()\n")
    assert [(r["kind"], r["name"]) for r in rows] == [("import", "a.b"), ("class", "X"), ("function", "f")]
    f = rows[-1]
    assert f["class"] == "X" and f["params"] == {"q": "int"} and f["return_type"] == "str" and f["docstring"] == "d" and f["code"].startswith("@staticmethod\n")
    assert python_source.parse_declarations("def (")[0]["kind"] == "error"


def walked(code):
    nodes, edges = python_source.flow(code)
    text = {i: t for i, t, _ in nodes}
    return {(text[a], text[b]) for a, b in edges}


def test_finally_is_passed_by_what_leaves():
    found = walked("def f():\n    try:\n        return 1\n    finally:\n        g()")
    assert {("return 1", "finally"), ("finally", "g()"), ("g()", "exit")} <= found and ("return 1", "exit") not in found
    found = walked("def f(x):\n    for i in x:\n        try:\n            if i:\n                break\n            continue\n        finally:\n            g()\n    h()")
    assert {("break", "finally"), ("continue", "finally"), ("g()", "for i in x"), ("g()", "merge"), ("h()", "exit")} <= found
    found = walked("def f(x):\n    try:\n        for i in x:\n            break\n    finally:\n        g()\n    h()")
    assert ("break", "merge") in found and ("break", "finally") not in found and ("g()", "h()") in found
    found = walked("def f():\n    try:\n        a()\n    except* ValueError:\n        b()")
    assert ("except* ValueError", "b()") in found
