"""Parsers by language: where other languages are plugged in."""

from __future__ import annotations

from collections.abc import Callable

#: language -> function from source text to rows of parse_schema().
PARSERS: dict[str, Callable[[str, str], list[dict]]] = {}
#: language -> function from a catalog's parsed tables (imports, classes, functions, calls) to calls with combinedName.
RESOLVERS: dict[str, Callable] = {}
#: language -> function from a function's source to (nodes, edges) of its control flow.
FLOWS: dict[str, Callable[[str], tuple[list[tuple[int, str, str]], list[tuple[int, int]]]]] = {}


def register(language: str) -> Callable:
    """Make a function the parser of a language."""
    def put(function: Callable) -> Callable:
        PARSERS[language] = function
        return function
    return put


def register_flow(language: str) -> Callable:
    """Make a function the control-flow builder of a language."""
    def put(function: Callable) -> Callable:
        FLOWS[language] = function
        return function
    return put


def register_resolver(language: str) -> Callable:
    """Make a function what tells the meaning of a language's calls; without one, a call means its own name."""
    def put(function: Callable) -> Callable:
        RESOLVERS[language] = function
        return function
    return put
