"""The value that events are joined on, as one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import ast


def _first(name: str) -> list[Column]:
    """The label, then the join key of that name; empty ones count as missing."""
    return [F.nullif(F.element_at(m, F.lit(name)), F.lit("")) for m in ("labels", "join_keys")]


def composite(ignoring: tuple[str, ...]) -> Column:
    """All labels and join keys but the ignored and the empty, as sorted name:value pairs; null if none is left."""
    empty = F.create_map().cast("map<string,string>")
    keys = F.coalesce("join_keys", empty)
    labels = F.map_filter(F.coalesce("labels", empty), lambda k, _: ~F.map_contains_key(keys, k))
    kept = F.map_filter(F.map_concat(labels, keys), lambda k, v: (v != "") & (~k.isin(*ignoring) if ignoring else F.lit(True)))
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return F.nullif(F.array_join(pairs, ","), F.lit(""))


def key(join: ast.Join, on_mode: str = "coalesce") -> Column:
    """The join value of an event, null if it has none.

    coalesce: the first name with a value counts, mappings' left and right names before all keys, on both sides.
    composite: all names must have one, and all are compared.
    """
    if not join.keys:
        return composite(join.ignoring or ())
    if on_mode == "composite":
        mapped = dict(join.mappings)
        parts = [F.coalesce(*(c for n in ((k, mapped[k]) if k in mapped else (k,)) for c in _first(n))) for k in join.keys]
        whole = F.array_join(F.array(*(F.regexp_replace(p, r"([\\,])", r"\\$1") for p in parts)), ",")
        return F.when(F.exists(F.array(*(p.isNull() for p in parts)), lambda x: x), F.lit(None)).otherwise(whole)
    names = [n for m in join.mappings for n in m] + list(join.keys)
    return F.coalesce(*(c for n in names for c in _first(n)))
