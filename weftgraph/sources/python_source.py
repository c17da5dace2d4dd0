"""Python source: imports, classes, functions and calls, function hashes, trees and control flow, on the standard library's ast."""

from __future__ import annotations

import ast
import hashlib
import re

from weftgraph.sources.registry import register, register_flow

GLOBAL = "Global"
ANY = "Any"


def type_name(node: ast.expr | None) -> str:
    """Name of an annotation's type."""
    if node is None:
        return ANY
    if isinstance(node, ast.Name):
        return node.id
    return node.attr if isinstance(node, ast.Attribute) else ast.unparse(node)


def _params(node: ast.FunctionDef) -> dict[str, str]:
    return {a.arg: type_name(a.annotation) for a in node.args.args}


def _locals(node: ast.FunctionDef) -> list[dict]:
    """Types of local variables: an annotation always says, an assigned call or attribute only if nothing did before."""
    found: dict[str, str] = {}
    for part in ast.walk(node):
        if isinstance(part, ast.AnnAssign) and isinstance(part.target, ast.Name):
            found[part.target.id] = type_name(part.annotation)
        elif isinstance(part, ast.Assign):
            for target in part.targets:
                if isinstance(target, ast.Name) and isinstance(part.value, ast.Call):
                    callee = part.value.func
                    name = callee.id if isinstance(callee, ast.Name) else ast.unparse(callee)
                    found.setdefault(target.id, name)
    return [{"name": k, "type": v} for k, v in found.items()]


class _Walk(ast.NodeVisitor):
    """Rows in source order; each knows the class and function around it."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.owner: dict | None = None
        self.function: dict | None = None

    def _row(self, kind: str, **values: object) -> dict:
        row = {"kind": kind, "local_id": len(self.rows), "class": self.owner["name"] if self.owner else GLOBAL, "class_bases": self.owner["bases"] if self.owner else [], "class_id": self.owner["local_id"] if self.owner else None, **values}
        self.rows.append(row)
        return row

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self._row("import", name=alias.name, as_name=alias.asname or alias.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for alias in node.names:
            self._row("import", name=alias.name, origin=node.module, as_name=alias.asname or alias.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        row = self._row("class", name=node.name, bases=[ast.unparse(b) for b in node.bases], docstring=ast.get_docstring(node))
        before, self.owner = self.owner, row
        self.generic_visit(node)
        self.owner = before

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        row = self._row("function", name=node.name, params=_params(node), return_type=type_name(node.returns), docstring=ast.get_docstring(node), code=ast.unparse(node), local_vars=_locals(node))
        before, self.function = self.function, row
        self.generic_visit(node)
        self.function = before

    def visit_Call(self, node: ast.Call) -> None:
        inside = self.function
        self._row("call", name=ast.unparse(node.func), position=node.lineno, func_id=inside["local_id"] if inside else None, func_name=inside["name"] if inside else None, params=inside["params"] if inside else {}, local_vars=inside["local_vars"] if inside else [])
        self.generic_visit(node)


@register("python")
def parse(source: str, path: str = "") -> list[dict]:
    """Import, class, function and call rows. Asynchronous functions give no row of their own; what can't be parsed gives an error row."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [{"kind": "error", "local_id": 0, "name": type(error).__name__}]
    walk = _Walk()
    walk.visit(tree)
    return walk.rows


class _Declarations(_Walk):
    """Declarations alone: asynchronous and decorated functions have rows too, as they are written, and calls have none."""

    def __init__(self, source: str) -> None:
        super().__init__()
        self.source = source

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        code = "\n".join(self.source.split("\n")[first - 1 : node.end_lineno])
        self._row("function", name=node.name, params=_params(node), return_type=ast.unparse(node.returns) if node.returns else None, docstring=ast.get_docstring(node), code=code.strip())
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        self.generic_visit(node)


@register("python_declarations")
def parse_declarations(source: str, path: str = "") -> list[dict]:
    """Import, class and function rows with asynchronous and decorated functions, without calls; parameters that are only positional or only named are left out."""
    try:
        walk = _Declarations(source)
        walk.visit(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [{"kind": "error", "local_id": 0, "name": type(error).__name__}]
    return walk.rows


def _stripped(source: str) -> str:
    """As functions.scalars.normalized_code."""
    plain = re.sub(r'(?s)""".*?"""', "", source)
    plain = re.sub(r"(?s)\'\'\'.*?\'\'\'", "", plain)
    return re.sub(r"[ \t\n\f\r\x0b]+", " ", re.sub(r"#[^\n]*", "", plain)).strip(" ")


def versioned_functions(source: str) -> list[dict]:
    """Functions, asynchronous ones too: qualified name, span of lines, code and the hash of its normalised form, in source order."""
    out: list[dict] = []

    def walk(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                walk(child, f"{owner}{child.name}.")
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                code = ast.get_source_segment(source, child) or ""
                out.append({"ordinal": len(out), "qualified_name": owner + child.name, "start_line": child.lineno, "end_line": child.end_lineno or child.lineno, "code": code, "body_hash": hashlib.sha256(_stripped(code).encode()).hexdigest()})
                walk(child, owner)
            else:
                walk(child, owner)

    try:
        walk(ast.parse(source), "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out


def body_hashes(source: str) -> list[dict]:
    """Hash of each function's lines, by its name with its class; the last of a name counts, and asynchronous ones don't."""
    found: dict[str, str] = {}
    lines = source.split("\n")

    def walk(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef):
                last = max((n.lineno for n in ast.walk(child) if hasattr(n, "lineno")), default=child.lineno)
                found[owner + child.name] = hashlib.sha256("\n".join(lines[child.lineno - 1 : last]).encode()).hexdigest()
            walk(child, f"{child.name}." if isinstance(child, ast.ClassDef) else owner)

    try:
        walk(ast.parse(source), "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [{"name": k, "body_hash": v} for k, v in found.items()]


def tree(code: str, drop_first: bool = False) -> list[dict]:
    """A function's syntax tree in pre-order: node_id from 0, parent_id, name, code, is_leaf; drop_first leaves out the first of several statements of every function."""
    out: list[dict] = []

    def walk(node: ast.AST, parent: int | None) -> None:
        own = len(out)
        kids = [c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.Load, ast.Store))]
        if drop_first and isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and len(node.body) > 1:
            kids = [c for c in kids if c is not node.body[0]]
        try:
            text = ast.unparse(node)
        except (AttributeError, ValueError, RecursionError):
            text = type(node).__name__
        out.append({"node_id": own, "parent_id": parent, "name": type(node).__name__, "code": text, "is_leaf": not kids})
        for child in kids:
            walk(child, own)

    try:
        walk(ast.parse(code), None)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out


@register_flow("python")
def flow(code: str) -> tuple[list[tuple[int, str, str]], list[tuple[int, int]]]:
    """Basic blocks of a function: (id, text, type) and edges; what can't be parsed gives neither."""
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError):
        return [], []
    if len(body) == 1 and isinstance(body[0], (ast.FunctionDef, ast.AsyncFunctionDef)):
        head, body = f"def {body[0].name}", body[0].body
    else:
        head = "module"
    nodes = [(0, "entry", "Entry"), (1, "exit", "Exit"), (2, head, "Function")]
    edges: list[tuple[int, int]] = [(0, 2)]

    def new(text: str, kind: str, before: list[int]) -> int:
        nodes.append((len(nodes), text, kind))
        edges.extend((b, len(nodes) - 1) for b in before)
        return len(nodes) - 1

    def leave(before: list[int], what: str, loop: tuple | None, final: list | None) -> None:
        """Lead a return, raise, break or continue to where it goes; through the finally block of a try that it leaves."""
        if final is not None and (what == "exit" or loop and loop[2] is not final):
            final.extend((b, what, loop) for b in before)
        elif what == "exit":
            edges.extend((b, 1) for b in before)
        elif loop and what == "continue":
            edges.extend((b, loop[0]) for b in before)
        elif loop:
            loop[1].extend(before)

    def run(statements: list[ast.stmt], before: list[int], loop: tuple | None, final: list | None) -> list[int]:
        block: list[str] = []

        def closed() -> None:
            nonlocal before
            if block and before:
                before = [new("\n".join(block), "BasicBlock", before)]
            block.clear()

        for s in statements:
            if isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)):
                closed()
            if not before:
                break
            if isinstance(s, ast.If):
                test = new(f"if {ast.unparse(s.test)}", "Branch", before)
                ends = run(s.body, [test], loop, final) + (run(s.orelse, [test], loop, final) if s.orelse else [test])
                before = [new("merge", "Merge", ends)] if ends else []
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                said = f"while {ast.unparse(s.test)}" if isinstance(s, ast.While) else f"for {ast.unparse(s.target)} in {ast.unparse(s.iter)}"
                test, breaks = new(said, "Branch", before), []
                edges.extend((e, test) for e in run(s.body, [test], (test, breaks, final), final))
                ends = run(s.orelse, [test], loop, final) + breaks
                before = [new("merge", "Merge", ends)] if ends else []
            elif isinstance(s, (ast.Try, ast.TryStar)):
                start, word = new("try", "Branch", before), "except*" if isinstance(s, ast.TryStar) else "except"
                left = [] if s.finalbody else final
                ends = run(s.body + s.orelse, [start], loop, left)
                for h in s.handlers:
                    ends += run(h.body, [new(f"{word} {ast.unparse(h.type) if h.type else ''}".strip(), "Branch", [start])], loop, left)
                if not s.finalbody:
                    before = [new("merge", "Merge", ends)] if ends else []
                    continue
                away = list(dict.fromkeys((what, id(to)) for _, what, to in left))
                known = {(what, id(to)): to for _, what, to in left}
                into = ends + [b for b, _, _ in left] + ([] if s.handlers or ends or left else [start])
                after = run(s.finalbody, [new("finally", "Merge", list(dict.fromkeys(into)))], loop, final)
                for what, key in away:
                    leave(after, what, known[what, key], final)
                before = after if ends else []
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                before = run(s.body, [new("with " + ", ".join(ast.unparse(i) for i in s.items), "BasicBlock", before)], loop, final)
            elif isinstance(s, ast.Match):
                start, ends = new(f"match {ast.unparse(s.subject)}", "Branch", before), []
                for case in s.cases:
                    ends += run(case.body, [new(f"case {ast.unparse(case.pattern)}", "Branch", [start])], loop, final)
                before = [new("merge", "Merge", ends + [start])]
            else:
                block.append(ast.unparse(s))
                if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                    closed()
                    leave(before, {ast.Break: "break", ast.Continue: "continue"}.get(type(s), "exit"), loop, final)
                    before = []
        closed()
        return before

    edges.extend((e, 1) for e in run(body, [2], None, None))
    return nodes, list(dict.fromkeys(edges))
