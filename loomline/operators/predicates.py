"""Selectors and filters as columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorrelationError
from ..plans import ast

Resolve = Callable[[str], Column]


def label_of(name: str) -> Column:
    """The label of an event, null if it is missing."""
    return F.element_at("labels", F.lit(name))


def valid_pattern(df: DataFrame | None, pattern: str) -> bool:
    """Whether the JVM compiles the pattern; without a session, whether Python does."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True
    try:
        sc._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - a PatternSyntaxException behind the gateway
        return False
    return True


def matcher(m: ast.Matcher, of: Resolve, anchored: bool) -> Column:
    """anchored: a selector's patterns match the whole value and a missing label is an empty text. Else a filter's
    match anywhere and a missing or empty label passes the negative operators alone; an invalid pattern matches nothing."""
    raw = of(m.label)
    value = F.coalesce(raw, F.lit(""))
    if anchored and m.value and m.op in ("=", "!="):  # plain comparisons reach a scan
        return raw == m.value if m.op == "=" else raw.isNull() | (raw != m.value)
    if m.op in ("=", "!="):
        hit = value == m.value
    else:
        if not valid_pattern(None, m.value):
            if anchored:
                raise CorrelationError(f"Invalid pattern: {m.value}", "QUERY_PARSE_ERROR")
            return F.lit(m.op == "!~")
        hit = value.rlike(rf"\A(?:{m.value})\z" if anchored else m.value)
    if not anchored:
        hit = (value != "") & hit
    return ~hit if m.op in ("!=", "!~") else hit


def all_of(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def selector(s: ast.Selector, of: Resolve = label_of) -> Column:
    """A selector over an event; of: a label's column, so what a source keeps in columns of its own reaches its scan."""
    if isinstance(s, ast.Labels):
        own = [of("__name__").eqNullSafe(F.lit(s.metric))] if s.metric is not None else []
        return all_of([*own, *(matcher(m, of, True) for m in s.matchers)])
    return _node(s.expr, of, False)


def _node(n: ast.Node, of: Resolve, strict: bool) -> Column:
    """strict: what is unknown must be false, as below a NOT; elsewhere a condition takes it for false anyway."""
    if isinstance(n, ast.Group):
        return _node(n.item, of, strict)
    if isinstance(n, ast.Bool):
        items = [_node(x, of, strict or n.op == "NOT") for x in n.items]
        if n.op == "NOT":
            return ~items[0]
        out = items[0]
        for x in items[1:]:
            out = out & x if n.op == "AND" else out | x
        return out
    out = _term(n, of(n.field))
    return F.coalesce(out, F.lit(False)) if strict else out


def _bare(value: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", value[1:-1]) if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _term(t: ast.Term, value: Column) -> Column:
    if t.kind in ("exists", "missing"):
        return value.isNotNull() if t.kind == "exists" else value.isNull()
    if t.kind == "wildcard":
        literal = re.sub(r"([%_\\])", r"\\\1", t.value.replace("\\*", "*"))
        return value.like(literal.replace("*", "%"))
    if t.kind == "value":
        return value == _bare(t.value)
    number = value.try_cast("double")
    if t.kind == "compare":
        limit = F.lit(_bare(t.value)).try_cast("double")
        return {">=": number >= limit, "<=": number <= limit, ">": number > limit, "<": number < limit}[t.op]
    ends = []
    for bound, low in ((t.value, True), (t.upper, False)):
        if bound == "*":
            ends.append(value.isNotNull())
        elif re.fullmatch(r"[0-9.]+", bound):
            ends.append(number >= float(bound) if low else number <= float(bound))
        else:
            ends.append(value >= bound if low else value <= bound)
    return ends[0] & ends[1]


def event_filter(matchers: tuple[ast.Matcher, ...] | None, of: Resolve = label_of) -> Column:
    """Which events of a correlation stay: those that satisfy every matcher."""
    return all_of([matcher(m, of, False) for m in matchers or ()])


def lenient(matchers: tuple[ast.Matcher, ...] | None) -> tuple[ast.Matcher, ...] | None:
    """Those of a query's filter that strict mode counts: a plain name and a value in double quotes that isn't empty. The others are passed over."""
    return None if matchers is None else tuple(m for m in matchers if re.fullmatch(r"\w+", m.label) and m.value and m.raw[:1] == '"')


#: A matcher that a filter's text keeps in strict mode: name, operator, a value in double quotes.
_STRICT = re.compile(r"\s*(\w+)\s*(=~|!=|!~|=)\s*\"([^\"]+)\"\s*")


def parse_filter(text: str, strict: bool = False) -> tuple[ast.Matcher, ...]:
    """Matchers of a filter's text. strict: what can't be read is left out, and a text without braces is no filter; else it is an error."""
    body = re.fullmatch(r"(?s)\s*\{(.*)\}\s*", text)
    if not body:
        if strict:
            return ()
        raise CorrelationError(f"Filter without braces: {text}", "QUERY_PARSE_ERROR")
    out = []
    for part in re.findall(r"(?:[^,\"]|\"[^\"]*\")+", body[1]):
        m = _STRICT.fullmatch(part)
        if m:
            out.append(ast.Matcher(m[1], m[2], m[3], f'"{m[3]}"'))
        elif not strict:
            raise CorrelationError(f"Invalid matcher: {part}", "QUERY_PARSE_ERROR")
    return tuple(out)
