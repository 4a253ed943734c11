"""Recursive-descent parser with ordered choice."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import TypeVar

from ..errors import CorrelationError
from . import ast

R = TypeVar("R")


@lru_cache(maxsize=64)
def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern)


IDENT = r"[a-zA-Z_][a-zA-Z0-9_:]*"
FIELD = r"[a-zA-Z_][a-zA-Z0-9_\-.]*"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


class _Fail(Exception):
    pass


class Reader:
    """A place in a text, and the furthest place that something else was expected at."""

    def __init__(self, text: str):
        self.text, self.at, self.far, self.want = text, 0, 0, set()

    def fail(self, what: str) -> None:
        if self.at > self.far:
            self.far, self.want = self.at, set()
        if self.at == self.far:
            self.want.add(what)
        raise _Fail

    def space(self, least: int = 0) -> None:
        m = _re(r"[ \t\r\n]*").match(self.text, self.at)
        if m.end() - self.at < least:
            self.fail("white space")
        self.at = m.end()

    def take(self, pattern: str, what: str) -> str:
        m = _re(pattern).match(self.text, self.at)
        if not m:
            self.fail(what)
        self.at = m.end()
        return m[0]

    def lit(self, word: str) -> str:
        if not self.text.startswith(word, self.at):
            self.fail(f'"{word}"')
        self.at += len(word)
        return word

    def keyword(self, word: str) -> str:
        """A word that isn't the start of a longer one."""
        start = self.at
        self.lit(word)
        if _re(r"[A-Za-z0-9_]").match(self.text, self.at):
            self.at = start
            self.fail(f'"{word}"')
        return word

    def first(self, *ways: Callable[[], R]) -> R:
        """The first way that succeeds."""
        start = self.at
        for k, way in enumerate(ways):
            try:
                return way()
            except _Fail:
                self.at = start
                if k + 1 == len(ways):
                    raise
        raise AssertionError

    def maybe(self, way: Callable[[], R]) -> R | None:
        start = self.at
        try:
            return way()
        except _Fail:
            self.at = start
            return None

    def many(self, way: Callable[[], R]) -> list[R]:
        out = []
        while True:
            start = self.at
            got = self.maybe(way)
            if got is None or self.at == start:
                self.at = start
                return out
            out.append(got)

    def listed(self, item: Callable[[], R]) -> list[R]:
        def more() -> R:
            self.space()
            self.lit(",")
            self.space()
            return item()

        return [item(), *self.many(more)]

    def inside(self, opening: str, closing: str, body: Callable[[], R]) -> R:
        self.lit(opening)
        self.space()
        out = body()
        self.space()
        self.lit(closing)
        return out

    # Words

    def string(self) -> tuple[str, str]:
        """A quoted text: raw and value. A backslash stands before what is taken as it is."""
        m = _re(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'").match(self.text, self.at)
        if not m:
            self.fail("a quoted text")
        self.at = m.end()
        value = _re(r"(?s)\\(.)").sub(r"\1", m[1] if m[1] is not None else m[2])
        return f"{m[0][0]}{value}{m[0][0]}", value

    def ident(self, what: str = "a name") -> str:
        return self.take(IDENT, what)

    def field(self, what: str = "a field") -> str:
        return self.take(FIELD, what)

    def duration(self) -> str:
        return self.take(rf"{NUMBER}[smhd]", "a duration")

    # Selectors

    def matcher(self) -> ast.Matcher:
        label = self.ident("a label")
        self.space()
        op = self.take(r"=~|!~|!=|=", "an operator")
        self.space()
        raw, value = self.first(self.string, lambda: (v := self.ident(), v))
        return ast.Matcher(label, op, value, raw)

    def matchers(self) -> tuple[ast.Matcher, ...]:
        return tuple(self.listed(self.matcher))

    def braces(self) -> tuple[ast.Matcher, ...]:
        return self.inside("{", "}", lambda: self.maybe(self.matchers) or ())

    def metric(self) -> ast.Labels:
        name = self.ident()

        def labelled() -> ast.Labels:
            self.space()
            return ast.Labels(self.braces(), name)

        return self.first(labelled, lambda: ast.Labels((), name))

    def selector(self) -> ast.Selector:
        """Labels, then boolean terms, then a metric, each up to the closing parenthesis."""

        def whole(way: Callable[[], ast.Selector]) -> Callable[[], ast.Selector]:
            def run() -> ast.Selector:
                out = way()
                start = self.at
                self.space()
                self.lit(")")
                self.at = start
                return out

            return run

        return self.first(whole(lambda: ast.Labels(self.braces())), whole(lambda: ast.Boolean(self.either())), whole(self.metric))

    def _chain(self, word: str, item: Callable[[], ast.Node]) -> ast.Node:
        def more() -> ast.Node:
            self.space()
            self.keyword(word)
            self.space()
            return item()

        items = [item(), *self.many(more)]
        return items[0] if len(items) == 1 else ast.Bool(word, tuple(items))

    def either(self) -> ast.Node:
        return self._chain("OR", lambda: self._chain("AND", self.negated))

    def negated(self) -> ast.Node:
        def no() -> ast.Node:
            self.keyword("NOT")
            self.space()
            return ast.Bool("NOT", (self.negated(),))

        return self.first(no, lambda: ast.Group(self.inside("(", ")", self.either)), self.term)

    def term(self) -> ast.Term:
        def presence(kind: str) -> Callable[[], ast.Term]:
            def run() -> ast.Term:
                self.lit(f"_{kind}_:")
                return ast.Term(kind, self.field())

            return run

        def named() -> ast.Term:
            field = self.field()
            self.lit(":")
            bound = lambda: self.take(rf"{NUMBER}|\*|{FIELD}", "a bound")

            def span() -> ast.Term:
                self.lit("[")
                low = bound()
                self.space()
                self.lit("TO")
                self.space()
                high = bound()
                self.lit("]")
                return ast.Term("range", field, low, high)

            def compare() -> ast.Term:
                op = self.take(">=|<=|>|<", "a comparison")
                return ast.Term("compare", field, self.value()[1], op=op)

            def plain() -> ast.Term:
                kind, value = self.value()
                return ast.Term(kind, field, value)

            return self.first(span, compare, plain)

        return self.first(presence("exists"), presence("missing"), named)

    def value(self) -> tuple[str, str]:
        wild = r"[a-zA-Z0-9_\-./\\]*\*[a-zA-Z0-9_\-./\\*]*"
        return self.first(lambda: ("value", self.string()[0]), lambda: ("wildcard", self.take(wild, "a wildcard")), lambda: ("value", self.take(r"[a-zA-Z0-9_\-./:]+", "a value")))

    # Queries

    def stream(self) -> ast.Stream:
        source = self.ident("a source")
        self.space()
        selector = self.inside("(", ")", self.selector)
        self.space()
        return ast.Stream(source, selector, self.inside("[", "]", self.duration))

    def join(self) -> ast.Join:
        kind = self.first(*(lambda w=w: self.keyword(w) for w in ("and", "or", "unless")))
        mappings: list[tuple[str, str]] = []

        def key() -> str:
            left = self.field("a key")

            def mapped() -> str:
                self.space()
                self.lit("=")
                self.space()
                mappings.append((left, self.field("a key")))
                return left

            return self.maybe(mapped) or left

        def on() -> list[str]:
            self.space(1)
            self.keyword("on")
            self.space()
            return self.inside("(", ")", lambda: self.listed(key))

        names = lambda: self.listed(self.ident)
        more: dict = {}

        def modifier() -> bool:
            self.space(1)

            def within() -> None:
                self.keyword("within")
                self.space()
                more["within"] = self.inside("(", ")", self.duration)

            def ignoring() -> None:
                self.keyword("ignoring")
                self.space()
                more["ignoring"] = tuple(self.inside("(", ")", names))

            def group() -> None:
                more["side"] = self.first(lambda: self.keyword("group_left"), lambda: self.keyword("group_right")).removeprefix("group_")

                def labels() -> list[str]:
                    self.space()
                    return self.inside("(", ")", lambda: self.maybe(names) or [])

                more["group_labels"] = tuple(self.maybe(labels) or ())

            self.first(within, ignoring, group)
            return True

        # `ignoring(...)` may stand without `on(...)`.
        keys = self.maybe(on) or []
        start = self.at
        self.many(modifier)
        if not keys and "ignoring" not in more:
            self.at = start
            self.fail('"on("')
        return ast.Join(kind, tuple(keys), tuple(mappings), **more)

    def query(self) -> ast.Query:
        self.space()
        streams, joins = [self.stream()], []

        def joined() -> bool:
            self.space()
            join = self.join()
            self.space()
            stream = self.stream()
            joins.append(join)
            streams.append(stream)
            return True

        self.many(joined)

        def braces() -> tuple[ast.Matcher, ...]:
            self.space()
            return self.inside("{", "}", self.matchers)

        found = self.maybe(braces)
        self.space()
        if self.at < len(self.text):
            self.fail("the end")
        warned = () if all(j == joins[0] for j in joins) else ("only the first join's settings take effect",)
        return ast.Query(tuple(streams), tuple(joins), found, warned)


def expected(text: str) -> set[str]:
    """What may stand at the end of an unfinished query; nothing if it can't go on from there."""
    r = Reader(text)
    try:
        r.query()
    except _Fail:
        pass
    return r.want if r.far == len(text) else set()


def _read(text: str) -> ast.Query:
    r = Reader(text)
    try:
        return r.query()
    except _Fail:
        line = text.count("\n", 0, r.far) + 1
        column = r.far - (text.rfind("\n", 0, r.far) + 1) + 1
        found = f'"{text[r.far]}"' if r.far < len(text) else "the end"
        raise CorrelationError(f"Query parse error at line {line}, column {column}: expected {' or '.join(sorted(r.want))}, found {found}", "QUERY_PARSE_ERROR", {"line": line, "column": column}) from None


def parse(text: str) -> ast.Query:
    """The tree of a query of two streams or more; CorrelationError QUERY_PARSE_ERROR otherwise."""
    q = _read(text)
    if len(q.streams) < 2:
        raise CorrelationError("Query parse error: at least two streams are needed", "QUERY_PARSE_ERROR")
    return q
