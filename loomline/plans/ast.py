"""The syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Matcher:
    """label op value; op is one of = != =~ !~. raw: the value as written."""

    label: str
    op: str
    value: str
    raw: str = ""

    def text(self) -> str:
        return f"{self.label}{self.op}{self.raw}"


@dataclass(frozen=True)
class Labels:
    """{a="x", b!~"y"}, or metric{...} with a metric's name."""

    matchers: tuple[Matcher, ...] = ()
    metric: str | None = None

    def text(self) -> str:
        body = ",".join(m.text() for m in self.matchers)
        return f"{{{body}}}" if self.metric is None else f"{self.metric}{{{body}}}" if self.matchers else self.metric


@dataclass(frozen=True)
class Bool:
    """AND or OR of two expressions, or NOT of one."""

    op: str
    items: tuple[Node, ...]

    def text(self) -> str:
        return f"NOT {self.items[0].text()}" if self.op == "NOT" else f" {self.op} ".join(x.text() for x in self.items)


@dataclass(frozen=True)
class Group:
    """An expression in parentheses."""

    item: Node

    def text(self) -> str:
        return f"({self.item.text()})"


@dataclass(frozen=True)
class Term:
    """field:value. kind: value, wildcard, exists, missing, range (value TO upper) or compare (op value)."""

    kind: str
    field: str
    value: str = ""
    upper: str = ""
    op: str = ""

    def text(self) -> str:
        if self.kind in ("exists", "missing"):
            return f"_{self.kind}_:{self.field}"
        return f"{self.field}:[{self.value} TO {self.upper}]" if self.kind == "range" else f"{self.field}:{self.op}{self.value}"


Node = Bool | Group | Term


@dataclass(frozen=True)
class Boolean:
    """A selector of boolean terms."""

    expr: Node

    def text(self) -> str:
        return self.expr.text()


Selector = Labels | Boolean


@dataclass(frozen=True)
class Stream:
    source: str
    selector: Selector
    time_range: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    """How a stream is joined. keys: names in order, with a mapping's left name in its place."""

    kind: str
    keys: tuple[str, ...] = ()
    mappings: tuple[tuple[str, str], ...] = ()
    within: str | None = None
    ignoring: tuple[str, ...] | None = None
    side: str | None = None
    group_labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    """Streams and the joins between them, one fewer; the first join rules. filter: matchers after the last stream."""

    streams: tuple[Stream, ...]
    joins: tuple[Join, ...]
    filter: tuple[Matcher, ...] | None = None
    warnings: tuple[str, ...] = field(default=(), compare=False)

    @property
    def join(self) -> Join:
        return self.joins[0]

    def filter_text(self) -> str | None:
        return None if self.filter is None else "{" + ",".join(m.text() for m in self.filter) + "}"
