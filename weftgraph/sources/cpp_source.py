"""C++ source by a linear scanner over brackets: includes, classes, functions, scoped variables and calls. No macros are expanded."""

from __future__ import annotations

import re
from bisect import bisect_left

from weftgraph.sources.registry import register

GLOBAL = "Global"
_SKIP = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', re.M)
_LABEL = re.compile(r"\s*(?:public|private|protected|default|case\s+[\w:]+)\s*:(?!:)")
_ATTRIBUTE = re.compile(r"\s*(?:\[\[[^\]]*\]\]|(?:template|requires)\b)")
_CLASS = re.compile(r"(?:typedef\s+)?(?:class|struct)\s+(?:alignas\s*\([^)]*\)\s*)?([A-Za-z_][\w:]*)\s*(?:final\b)?")
_NAME = re.compile(r"[A-Za-z_~][\w~]*")
_VARIABLE = re.compile(r"(?<=[;{}(\n])[ \t]*((?:(?:const|static|constexpr)\s+)*[A-Za-z_][\w:]*(?:<[\w:,\s*&]*>)?(?:\s+const\b)?[\s*&]+)(\w+)[ \t]*(?=[=;({\[]|:(?!:))")
_CALLED = re.compile(r"(?:\bnew\s+([A-Za-z_][\w:]*)|(?<!\w)(?<!\w::)(?<!\w\.)(?<!\w->)(~?[A-Za-z_]\w*+(?:(?:::|\.|->)~?\w++)*+))\s*+(?:<[\w:,\s*&]*>)?\s*\(")
# Words that stand before a bracket without being called, and words before a type that aren't part of it.
_WORDS = frozenset("if for while switch return catch sizeof alignof decltype static_assert else do throw delete new operator defined noexcept alignas typeid and or not co_await co_return co_yield case goto using typename".split())
_TYPES = frozenset("int bool char short long float double void auto unsigned signed".split())
_SPECIFIERS = frozenset("static inline virtual explicit constexpr consteval friend extern mutable typename".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


def blanked(source: str) -> str:
    """The source with comments as spaces and the insides of texts as underscores, at the same places."""
    def blank(m: re.Match) -> str:
        text = m[0]
        return f'"{re.sub(r"[^\n]", "_", text[1:-1])}"' if text[0] == '"' and len(text) > 1 else re.sub(r"[^\n]", " ", text)
    return _SKIP.sub(blank, source)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts of a list, at marks outside all brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] != "-":
            depth -= 1
        elif c == mark and depth <= 0:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in (*parts, text[at:]) if p.strip()]


def _closed(text: str, at: int, signs: str) -> int:
    """Just behind what closes the bracket that opens at a place; the text's end if nothing does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == signs[0]) - (text[i] == signs[1])
        if not depth:
            return i + 1
    return len(text)


def _header(text: str) -> str:
    """A header without access labels, attributes and template parameters."""
    at = 0
    while m := _LABEL.match(text, at) or _ATTRIBUTE.match(text, at):
        at = m.end()
        if m[0].strip() == "template":
            left = re.compile(r"\s*<").match(text, at)
            at = _closed(text, left.end() - 1, "<>") if left else at
    return text[at:].strip()


def _declared(before: str) -> tuple[str, str]:
    """(type, qualified name) of what stands before a parameter list."""
    operator = before.rfind("operator")
    if operator >= 0 and not re.match(r"\w", before[operator + 8 : operator + 9]):
        end, start = len(before), operator
    else:
        end = start = len(before.rstrip())
        while start and (before[start - 1].isalnum() or before[start - 1] in "_~"):
            start -= 1
    while before[:start].rstrip().endswith("::"):
        start = len(before[:start].rstrip()) - 2
        if before[:start].rstrip().endswith(">"):
            depth = 0
            for i in range(start - 1, -1, -1):
                depth += (before[i] == ">") - (before[i] == "<")
                if not depth and before[i] == "<":
                    start = i
                    break
        while start and (before[start - 1].isalnum() or before[start - 1] == "_"):
            start -= 1
    kept = [w for w in before[:start].split() if w not in _SPECIFIERS]
    return " ".join(kept), re.sub(r"\s+", "", re.sub(r"<.*?>(?=::)", "", before[start:end].strip()))


def _function(header: str) -> dict | None:
    """name, owner, return type and parameters of a function's header; nothing if it is none."""
    called = re.search(r"operator\s*\(\s*\)", header)
    opening = header.find("(", called.end() if called else 0)
    if opening < 0 or ("=" in header[:opening] and "operator" not in header[:opening]):
        return None
    kind, name = _declared(header[:opening])
    owner, _, own = name.rpartition("::")
    if not own or own in _WORDS or not re.match(r"~?[A-Za-z_]", own) or kind.split()[-1:] in (["new"], ["return"], ["else"], ["throw"]):
        return None
    closing = _closed(header, opening, "()")
    rest = re.sub(r"noexcept\s*\([^)]*\)|\b(?:const|noexcept|override|final|volatile|try|mutable)\b|&", " ", header[closing:]).strip()
    arrow = re.match(r"->\s*(.+)$", rest, re.S)
    if rest and not arrow and not (rest.startswith(":") and not rest.startswith("::")) and not rest.startswith("requires"):
        return None
    params: dict[str, str] = {}
    for i, p in enumerate(split_top(header[opening + 1 : closing - 1])):
        p = split_top(p, "=")[0] if "=" in p else p
        if p == "void":
            continue
        pointer = re.search(r"\(\s*[*&]+\s*(\w+)\s*\)", p)
        named = re.match(r"(.*[\s*&>])([A-Za-z_]\w*)(?:\s*\[[^\]]*\])*$", p, re.S)
        if pointer:
            params[pointer[1]] = re.sub(r"\s+", " ", p.replace(pointer[1], "", 1))
        elif named and named[1].strip() not in ("const", "unsigned", "struct", ""):
            params[named[2]] = re.sub(r"\s*([*&]+)\s*", r" \1", re.sub(r"\s+", " ", named[1].strip()))
        else:
            params[f"arg{i}"] = p
    return {"name": own, "owner": owner, "return_type": (arrow[1].strip() if arrow else kind) or None, "params": params}


def _class(header: str) -> tuple[str, list[str]] | None:
    """(name, bases) of a class's header."""
    m = _CLASS.match(header)
    if not m:
        return None
    rest = header[m.end() :].strip()
    if rest.startswith("<"):
        rest = rest[_closed(rest, 0, "<>") :].strip()
    if rest and (not rest.startswith(":") or rest.startswith("::")):
        return None
    plain = (re.sub(r"\b(?:public|private|protected|virtual)\b", "", b).strip() for b in split_top(rest[1:]))
    return m[1], [re.sub(r"<.*>", "", b, flags=re.S).strip() for b in plain]


class _Scan:
    """One pass over the brackets: classes, functions and the span of every block."""

    def __init__(self, plain: str) -> None:
        self.plain, self.opens, self.closes, self.parents = plain, [], [], []
        self.classes: list[tuple[int, int, str, list[str]]] = []
        self.functions: list[tuple[int, int, int, dict, int | None]] = []
        self.heads: set[int] = set()
        stack: list[tuple[str, int, int, object]] = []  # sign, place, block, meaning
        self.around: list[tuple[object, bool]] = []  # meaning of the blocks around, and whether a function is among them
        begin, round_depth = 0, 0
        for m in re.finditer(r"[(){}\[\];]|^[ \t]*#[^\n]*", plain, re.M):
            c, at = m[0], m.start()
            if "#" in c:
                begin = m.end() if not round_depth else begin
            elif c == ";":
                begin = at + 1 if not round_depth else begin
            elif c in "([":
                stack.append((c, at, -1, None))
                round_depth += 1
            elif c == "{":
                meaning = self._meaning(begin, at, round_depth)
                self.opens.append(at)
                self.closes.append(len(plain))
                self.parents.append(next((b for _, _, b, _ in reversed(stack) if b >= 0), -1))
                stack.append((c, at, len(self.opens) - 1, meaning))
                if meaning != "initial":
                    stack[-1] = (c, at, len(self.opens) - 1, (meaning, round_depth))
                    self.around.append((meaning, meaning == "function" or bool(self.around) and self.around[-1][1]))
                    begin, round_depth = at + 1, 0
            elif stack:
                while stack and stack[-1][0] != _PAIRS[c] and c == "}":
                    stack.pop()
                if not stack or stack[-1][0] != _PAIRS[c]:
                    continue
                _, _, block, meaning = stack.pop()
                if c != "}":
                    round_depth = max(0, round_depth - 1)
                    continue
                self.closes[block] = at + 1
                if meaning != "initial":
                    self.around.pop()
                    begin, round_depth = at + 1, meaning[1]
        self.classes = [(a, self.closes[a], n, b) for a, n, b in self.classes]
        self.functions = [(s, b, self.closes[b], f, o) for s, b, f, o in self.functions]

    def _meaning(self, begin: int, at: int, round_depth: int) -> object:
        """What the block at a place is: a class, a function, the braces of an initialiser, or a plain block."""
        if round_depth:
            return "block"
        header = _header(self.plain[begin:at])
        around, in_function = self.around[-1] if self.around else (None, False)
        local_class = isinstance(around, tuple)
        found = _class(header)
        if found:
            self.classes.append((len(self.opens), *found))
            return ("class", len(self.classes) - 1)
        if in_function and not local_class:
            return "block"
        what = _function(header)
        if what is None:
            return "block"
        rest = header[_closed(header, header.find("("), "()") :]
        if re.search(r"(?<!:):(?!:)", rest) and re.search(r"[\w>]\s*$", rest) and not re.search(r"\b(?:const|noexcept|override|final|try)\s*$", rest):
            return "initial"
        start = self.plain.rfind(header, begin, at)
        opening = self.plain.find("(", start)
        self.heads.update(range(start, opening + 1))
        self.functions.append((start, len(self.opens), what, around[1] if local_class else None))
        return "function"

    def block(self, at: int) -> int:
        """The innermost block around a place, or -1."""
        i = bisect_left(self.opens, at) - 1
        while i >= 0 and self.closes[i] <= at:
            i = self.parents[i]
        return i


def _chain(plain: str, at: int, names: dict[int, str], pairs: dict[int, int]) -> str:
    """What a call's name hangs on: the call that ends just before it, as `a.b().`."""
    before = plain[max(0, at - 200) : at].rstrip()
    sign = "->" if before.endswith("->") else "." if before.endswith(".") else ""
    if not sign:
        return ""
    end = at - (min(at, 200) - len(before)) - len(sign)
    while end and plain[end - 1].isspace():
        end -= 1
    name = names.get(pairs.get(end - 1, -1)) if end and plain[end - 1] == ")" else None
    return f"{name}()." if name else ""


@register("cpp")
def parse_cpp(source: str, path: str = "") -> list[dict]:
    """Includes, classes and structs with bases, functions with bodies, calls with their place and the variables of the blocks around them."""
    rows: list[dict] = []

    def add(kind: str, **values: object) -> dict:
        rows.append({"kind": kind, "local_id": len(rows), "class": GLOBAL, "class_bases": [], **values})
        return rows[-1]

    for m in _INCLUDE.finditer(source):
        add("import", name=m[1], as_name=m[1])
    plain = blanked(source)
    scan = _Scan(plain)
    classes = [add("class", name=name, bases=bases) for _, _, name, bases in scan.classes]
    found: dict[int, dict] = {}
    for start, block, end, what, owner in scan.functions:
        around = classes[owner] if owner is not None else None
        begin = scan.opens[block]
        variables = []
        for v in _VARIABLE.finditer(plain, begin, end):
            inside = scan.block(v.start(2))
            if inside >= 0 and not set(v[1].split()) & _WORDS:
                kind = re.sub(r"\b(?:static|constexpr)\b", "", v[1]).strip()
                variables.append({"name": v[2], "type": re.sub(r"\s+", " ", kind), "start": scan.opens[inside], "end": scan.closes[inside]})
        found[block] = add(
            "function", name=what["name"], params=what["params"], return_type=what["return_type"], code=source[start:end].strip(), local_vars=variables, class_bases=around["bases"] if around else [],
            class_id=around["local_id"] if around else None, **{"class": what["owner"] or (around["name"] if around else GLOBAL)},
        )
    opened, pairs = [], {}
    for m in re.finditer(r"[()]", plain):
        if m[0] == "(":
            opened.append(m.start())
        elif opened:
            pairs[m.start()] = opened.pop()
    names: dict[int, str] = {}
    for m in _CALLED.finditer(plain):
        name = m[1] or m[2]
        if name in _WORDS or name in _TYPES or m.start() in scan.heads:
            continue
        block = scan.block(m.start())
        while block >= 0 and block not in found:
            block = scan.parents[block]
        inside = found.get(block)
        first = plain[max(0, m.start() - 40) : m.start()].split()[-1:]
        if inside is None and first and re.fullmatch(r"[\w:>*&]+", first[0]) and first[0] not in _WORDS:
            continue  # a declaration without a body
        name = _chain(plain, m.start(), names, pairs) + name.replace("->", ".")
        names[m.end() - 1] = name
        add("call", name=name, position=m.start(), func_id=inside["local_id"] if inside else None, func_name=inside["name"] if inside else None, params=inside["params"] if inside else {}, local_vars=inside["local_vars"] if inside else [], class_bases=inside["class_bases"] if inside else [], **{"class": inside["class"] if inside else GLOBAL})
    return rows
