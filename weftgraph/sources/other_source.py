"""Erlang source by a hand-written scanner: less than a grammar, enough for plain declarations and calls."""

from __future__ import annotations

import re

from weftgraph.sources.registry import register, register_flow

GLOBAL = "Global"


def _blank(source: str, pattern: re.Pattern) -> str:
    """The source with what matches blanked, but for the quotes of a text, which stays one argument."""
    return pattern.sub(lambda m: f'"{re.sub("[^\n]", "_", m[0][1:-1])}"' if m[0][0] == '"' and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0]), source)


_ERL_SKIP = re.compile(r'%[^\n]*|"(?:\\.|[^"\\])*"')
_ERL_CLAUSE = re.compile(r"^([a-z]\w*|'[^'\n]+')\s*\(", re.M)
_ERL_CALL = re.compile(r"(?:\b([a-z]\w*)\s*:\s*)?(?<![\w@?#'])([a-z]\w*)\s*\(")
_ERL_WORDS = frozenset("case if receive try of end after when fun begin catch maybe else and or not andalso orelse div rem band bor bxor bnot bsl bsr xor".split())


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of the bracket that opens at start, and where it is closed."""
    depth, parts, at = 0, [], start + 1
    for i in range(start, len(text)):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                last = text[at:i].strip()
                return ([*parts, last] if last else parts), i + 1
        elif c == "," and depth == 1:
            parts.append(text[at:i].strip())
            at = i + 1
    return parts, len(text)


@register("erlang")
def parse_erlang(source: str, path: str = "") -> list[dict]:
    """Imports, functions (one row for all clauses in a row) and calls as module:name/arity; spawn and apply count as what they start."""
    rows: list[dict] = []
    module = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])

    def add(kind: str, **values: object) -> dict:
        rows.append({"kind": kind, "local_id": len(rows), "class": GLOBAL, "class_bases": [], **values})
        return rows[-1]

    plain = _blank(source, _ERL_SKIP)
    for m in re.finditer(r"^-import\(\s*([a-z]\w*)", plain, re.M):
        add("import", name=m[1], as_name=m[1])
    before: dict | None = None
    for m in _ERL_CLAUSE.finditer(plain):
        params, at = _arguments(plain, m.end() - 1)
        arrow = re.match(r"\s*(?:when\b[^.]*?)?->", plain[at:])
        if not arrow:
            continue
        stop = re.compile(r"\.(?:\s|\Z)|;(?=\s*\n" + re.escape(m[1]) + r"\s*\()").search(plain, at)
        end = stop.end() if stop else len(plain)
        named = {p if re.fullmatch(r"\w+|\"[^\"]*\"", p) else f"arg{i}": "Any" for i, p in enumerate(params)}
        name = f"{module}:{m[1]}/{len(named)}"
        if before is None or before["qualified"] != name:
            before = add("function", name=m[1], params=named, code=source[m.start() : end].strip(), qualified=name)
        else:
            before["code"] += "\n" + source[m.start() : end].strip()
        for c in _ERL_CALL.finditer(plain, at, end):
            if c[2] in _ERL_WORDS:
                continue
            args, _ = _arguments(plain, c.end() - 1)
            target, function, arity = c[1] or module, c[2], len(args)
            if function in ("spawn", "spawn_link", "spawn_monitor", "apply") and len(args) >= 3:
                target, function, arity = args[-3].replace("?MODULE", module), args[-2], len(_arguments(args[-1], 0)[0]) if args[-1].startswith("[") else 0
            if re.fullmatch(r"[a-z]\w*", target) and re.fullmatch(r"[a-z]\w*", function):
                add("call", name=f"{target}:{function}/{arity}", qualified=f"{target}:{function}/{arity}", position=c.start(), func_id=before["local_id"], func_name=before["name"], params=before["params"])
    return rows


@register_flow("erlang")
def flow_erlang(code: str) -> tuple[list[tuple[int, str, str]], list[tuple[int, int]]]:
    """Control flow of a function's first clause: entry, the signature, its expressions, with branches and merge for case, if, receive, try and maybe."""
    plain = _blank(code, re.compile(r"%[^\n]*"))
    head, _, body = plain.partition("->")
    body = re.split(r";(?=\s*\n[a-z]\w*\s*\()|\.\s*$", body)[0]
    nodes = [(0, "entry", "Entry"), (1, "exit", "Exit"), (2, head.strip(), "Function")]
    edges = [(0, 2)]

    def new(text: str, kind: str, before: list[int]) -> int:
        nodes.append((len(nodes), " ".join(text.split()), kind))
        edges.extend((b, len(nodes) - 1) for b in before)
        return len(nodes) - 1

    def parts(text: str, mark: str) -> list[str]:
        out, depth, at = [], 0, 0
        for m in re.finditer(r"\b(?:case|if|receive|try|begin|maybe|end)\b|\bfun\s*\(|[(\[{]|[)\]}]|->|[,;]", text):
            w = m[0]
            if w == "end" or w in ")]}":
                depth -= 1
            elif re.match(r"case|if|receive|try|begin|maybe|[(\[{]", w) :
                depth += 1
            elif w.startswith("fun"):
                depth += 2
            elif w == mark and not depth:
                out.append(text[at : m.start()])
                at = m.end()
        return [x.strip() for x in (*out, text[at:]) if x.strip()]

    def cut(text: str, words: str) -> list[tuple[str, str]]:
        """Sections of a construct by its own keywords."""
        out, depth, at, name = [], 0, 0, ""
        for m in re.finditer(r"\b(?:case|if|receive|try|begin|maybe|end|of|catch|after|else)\b", text):
            if m[0] == "end":
                depth -= 1
            elif m[0] in ("case", "if", "receive", "try", "begin", "maybe"):
                depth += 1
            elif not depth and m[0] in words.split():
                out.append((name, text[at : m.start()]))
                name, at = m[0], m.end()
        return [*out, (name, text[at:])]

    def clauses(text: str, before: list[int], word: str) -> list[int]:
        ends = []
        for clause in parts(text, ";"):
            pattern, _, then = clause.partition("->")
            pattern, _, guard = pattern.partition(" when ")
            at = new(f"{word}{pattern}", "Branch", before)
            ends += run(then, [new(f"when {guard}", "Branch", [at]) if guard else at])
        return ends

    def run(text: str, before: list[int]) -> list[int]:
        for expression in parts(text, ","):
            m = re.match(r"(?:[A-Z_]\w*\s*=\s*)?(case|if|receive|try|maybe)\b(.*)\bend$", expression, re.S)
            if not m:
                kind = "Call" if re.match(r"(?:[A-Z_]\w*\s*=\s*)?(?:\w+:)?[a-z]\w*\s*\(", expression) else "BasicBlock"
                before = [new(expression, kind, before)]
                continue
            sections = cut(m[2], {"case": "of", "receive": "after", "try": "of catch after", "maybe": "else", "if": ""}[m[1]])
            first = sections[0][1]
            ends: list[int] = []
            if m[1] == "case":
                start = new(f"case {first}", "Branch", before)
            elif m[1] in ("try", "maybe"):
                start = None
                ends = run(first, before)
                before = ends or before
            else:
                start = None
                ends = clauses(first, before, "")
            for name, section in sections[1:]:
                if m[1] == "case":
                    ends += clauses(section, [start], "")
                elif name == "of":
                    ends = clauses(section, ends, "")
                elif name == "after" and m[1] == "try":
                    ends = run(section, [new("merge", "Merge", ends)])
                else:
                    ends = ends + clauses(section, before, f"{name} " if name == "after" else "")
            before = [new("merge", "Merge", ends or before)]
        return before

    edges.extend((e, 1) for e in run(body, [2]))
    return nodes, list(dict.fromkeys(edges))
