"""Validation, formatting, completion and a builder of queries."""

from __future__ import annotations

import re
from dataclasses import replace

from ..errors import CorrelationError
from . import ast
from .parser import expected, parse

#: What completion offers. Fixed values.
RANGES = ["[5m]", "[1m]", "[30s]", "[1h]", "[24h]"]
JOINS = ["and on(", "or on(", "unless on("]
MODIFIERS = ["within(", "ignoring(", "group_left(", "group_right("]
KEYS = ["request_id", "trace_id", "session_id", "correlation_id", "span_id"]
LABELS = ["service=", "level=", "job=", "instance=", "status="]
SOURCES = ["loki(", "graylog(", "promql("]
VALUES = {
    "service": ['"frontend"', '"backend"', '"database"', '"cache"'],
    "level": ['"info"', '"warn"', '"error"', '"debug"'],
    "status": ['"200"', '"404"', '"500"', '"4.."', '"5.."'],
}


def validate(text: str) -> dict:
    """{valid, details} of a query, or {valid, error}. A single stream isn't valid."""
    try:
        q = parse(text)
    except CorrelationError as e:
        return {"valid": False, "error": str(e)}
    details = {"streams": len(q.streams), "joinType": q.join.kind, "temporal": q.join.within is not None, "hasFilter": q.filter is not None, "hasLabelMappings": bool(q.join.mappings)}
    return {"valid": True, "details": details, "warnings": list(q.warnings)}


#: What is offered where the parser expects these.
_OFFERS = {'"within"': MODIFIERS, "a source": SOURCES, '"["': RANGES, '"and"': JOINS, "a key": KEYS, "a label": LABELS}
_ASKED = re.compile(r"([A-Za-z_][A-Za-z0-9_:]*)\s*(?:=~|!~|!=|=)\s*\Z")


def suggest(text: str, position: int) -> list[str]:
    """What may follow at a place of an unfinished query: offers for all that the parser expects there, values by their label."""
    head = text[:position]
    want = expected(head)
    if "a quoted text" in want and (m := _ASKED.search(head)):
        return list(VALUES.get(m[1], []))
    if '"within"' in want and not head[-1:].isspace():
        return []  # a modifier stands apart
    return [x for what, offer in _OFFERS.items() if what in want for x in offer]


def _join_text(j: ast.Join) -> str:
    mapped, words = dict(j.mappings), [j.kind]
    if j.keys:
        words.append("on(" + ", ".join(f"{k}={mapped[k]}" if k in mapped else k for k in j.keys) + ")")
    words += [f"within({j.within})"] if j.within else []
    words += ["ignoring(" + ", ".join(j.ignoring) + ")"] if j.ignoring is not None else []
    words += [f"group_{j.side}(" + ", ".join(j.group_labels) + ")"] if j.side else []
    return " ".join(words)


def format_query(text: str) -> str:
    """The query over several lines, every join with all that it says; a text that doesn't parse comes back as it is."""
    try:
        q = parse(text)
    except CorrelationError:
        return text
    show = lambda s: f"{s.source}({s.selector.text()})[{s.time_range}]"
    lines = [show(q.streams[0])]
    for j, s in zip(q.joins, q.streams[1:], strict=True):
        lines += ["  " + _join_text(j), "  " + show(s)]
    return "\n".join([*lines, *([q.filter_text()] if q.filter is not None else [])])


class QueryBuilder:
    """Builds a query step by step: streams, and between two of them a join with its settings; build() gives the text, checked."""

    def __init__(self):
        self.streams: list[str] = []
        self.joins: list[ast.Join] = []
        self.filter: str | None = None

    def _set(self, **what: object) -> QueryBuilder:
        if len(self.joins) < len(self.streams) or not self.joins:
            raise ValueError("a join's settings follow the join and stand before its stream")
        self.joins[-1] = replace(self.joins[-1], **what)
        return self

    def add_stream(self, source: str, selector: str, time_range: str) -> QueryBuilder:
        if len(self.streams) != len(self.joins):
            raise ValueError("two streams need a join between them")
        self.streams.append(f"{source}({selector})[{time_range}]")
        return self

    and_stream = add_stream

    def join(self, kind: str, keys: list[str]) -> QueryBuilder:
        """keys: names, or left=right for a mapping."""
        if len(self.streams) != len(self.joins) + 1:
            raise ValueError("a join stands between two streams")
        pairs = [k.split("=", 1) for k in keys]
        self.joins.append(ast.Join(kind, tuple(p[0].strip() for p in pairs), tuple((p[0].strip(), p[1].strip()) for p in pairs if len(p) > 1)))
        return self

    def with_temporal(self, window: str) -> QueryBuilder:
        return self._set(within=window)

    def with_ignoring(self, labels: list[str]) -> QueryBuilder:
        return self._set(ignoring=tuple(labels))

    def with_grouping(self, side: str, labels: list[str] | None = None) -> QueryBuilder:
        return self._set(side=side, group_labels=tuple(labels or ()))

    def with_filter(self, text: str) -> QueryBuilder:
        self.filter = text
        return self

    def build(self) -> str:
        """The query's text; CorrelationError if it isn't one."""
        if not self.streams or len(self.streams) != len(self.joins) + 1:
            raise ValueError("a query is streams with joins between them")
        text = " ".join([self.streams[0], *(f"{_join_text(j)} {s}" for j, s in zip(self.joins, self.streams[1:], strict=True)), *([self.filter] if self.filter else [])])
        parse(text)
        return text
