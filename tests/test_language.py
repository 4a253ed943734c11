import pytest

from loomline.errors import CorrelationError
from loomline.plans import ast
from loomline.plans.parser import parse
from loomline.plans.tooling import QueryBuilder, format_query, suggest, validate

Q = 'a({s="x"})[5m] and on(id) within(30s) b(service:api AND level:ERROR)[5m] {status=~"4..|5.."}'


def test_parse_parts():
    q = parse(Q)
    assert [s.source for s in q.streams] == ["a", "b"]
    assert q.join == ast.Join("and", ("id",), within="30s")
    assert q.filter == (ast.Matcher("status", "=~", "4..|5..", '"4..|5.."'),)
    assert q.streams[1].selector.text() == "service:api AND level:ERROR"
    j = parse("a({})[5m] or on(k=j, z) group_left(x) ignoring(q) b(m)[1h] unless on(k) c(x:5* OR NOT y:[1 TO *])[1d]").joins
    assert j[0].mappings == (("k", "j"),) and j[0].keys == ("k", "z") and j[0].side == "left" and j[0].ignoring == ("q",)


def test_keyword_glue_and_escapes():
    assert parse("a(NOTE:1)[5m] and on(k) b({x=\"5\\\\d\"})[5m]").streams[1].selector.matchers[0].value == "5\\d"
    assert parse("a(NOTE:1)[5m] and on(k) b({})[5m]").streams[0].selector == ast.Boolean(ast.Term("value", "NOTE", "1"))


@pytest.mark.parametrize("bad", ["", "a({})[5m]", "a({x=})[5m] and on(k) b({})[5m]", "a({})[5m] xor on(k) b({})[5m]", "a({}) and on(k) b({})[5m]", "a({})[5m] and on() b({})[5m]", "a({})[500ms] and on(x) b({})[5m]", "a(rate(x))[5m] and on(k) b({})[5m]"])
def test_errors(bad):
    with pytest.raises(CorrelationError) as e:
        parse(bad)
    assert e.value.code == "QUERY_PARSE_ERROR"
    assert not validate(bad)["valid"]


def test_position():
    with pytest.raises(CorrelationError) as e:
        parse("a({})[5m]\n  and on(k) 7")
    assert e.value.details == {"line": 2, "column": 13}


def test_tools():
    assert validate(Q)["details"] == {"streams": 2, "joinType": "and", "temporal": True, "hasFilter": True, "hasLabelMappings": False}
    assert parse(format_query(Q)) == parse(Q) and format_query("nonsense(") == "nonsense("
    assert suggest("", 0)[0] == "loki(" and "and on(" in suggest("a({})[5m] ", 10)
    assert "request_id" in suggest("a({})[5m] and on(", 17) and suggest("a({level=", 9)[0] == '"info"'
    text = QueryBuilder().add_stream("a", "{}", "5m").join("and", ["k"]).with_temporal("30s").and_stream("b", "{}", "5m").build()
    assert parse(text).join.within == "30s"
    for wrong in (lambda b: b.join("and", ["k"]), lambda b: b.add_stream("a", "{}", "5m").add_stream("b", "{}", "5m"), lambda b: b.add_stream("a", "{}", "5m").with_temporal("5s"), lambda b: b.build()):
        with pytest.raises(ValueError):
            wrong(QueryBuilder())
    with pytest.raises(CorrelationError):
        QueryBuilder().add_stream("a", "{x}", "5m").join("and", ["k"]).add_stream("b", "{}", "5m").build()
    text = QueryBuilder().add_stream("a", "{}", "5m").join("or", ["k=j", "z"]).with_ignoring(["q"]).with_grouping("left", ["x"]).add_stream("b", "{}", "5m").with_filter('{s="1"}').build()
    j = parse(text).join
    assert (j.mappings, j.keys, j.ignoring, j.side, j.group_labels) == ((("k", "j"),), ("k", "z"), ("q",), "left", ("x",))


def test_suggestions_follow_the_parser():
    at = lambda t: suggest(t, len(t))
    assert at("a({}) ") == at("a({})") == ["[5m]", "[1m]", "[30s]", "[1h]", "[24h]"]
    assert at("a({})[5m] and on(x) ")[:4] == ["within(", "ignoring(", "group_left(", "group_right("] and "loki(" in at("a({})[5m] and on(x) ")
    assert at("a({")[0] == at('a({level="x", ')[0] == "service=" and at("a({status!~")[-1] == '"5.."' and at("a({other=") == []
    assert at("a({})[5m] and on(k, ")[0] == "request_id" and at("a({})[5m] xor ") == [] and at("a(x:1 AND ") == []
    assert "and on(" in at("a({})[5m] and on(k) b({})[5m] ")
