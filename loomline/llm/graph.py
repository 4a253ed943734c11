"""Connected components over an edge table by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared


def components(edges: DataFrame, shared: Shared, name: str = "components") -> DataFrame:
    """edges: a, b long. Returns v, comp: each vertex with the smallest vertex that edges reach from it.

    Every round maps each vertex to the least vertex two hooks away and contracts the edges, so a star takes one
    round and a path of n vertices about log n. All state is in tables of the shared folder; nothing is collected
    but row counts. Null ends and loops are ignored; an empty edge table gives an empty result. name: what `shared` has
    the result under, unless it is empty.
    """
    live = shared.write(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges0")
    hooks: list[DataFrame] = []
    k = 0
    while not live.isEmpty():
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select(F.col("b").alias("v"), F.col("a").alias("u")))
        hook = shared.write(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("p")), f"hook{k}")
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        hook2 = shared.write(hook.join(up, "p").select("v", F.col("pp").alias("p")), f"jump{k}")
        hooks.append(hook2)
        to_a = hook2.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        to_b = hook2.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        nxt = live.join(to_a, "a").join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        live = shared.write(nxt, f"edges{k + 1}")
        shared.drop(f"edges{k}", f"hook{k}")
        k += 1
    if not hooks:
        return live.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    out = hooks[-1].select(F.col("v").alias("v"), F.col("p").alias("comp"))
    for hook in reversed(hooks[:-1]):
        up = out.select(F.col("v").alias("p"), "comp")
        out = hook.join(up, "p", "left").select("v", F.coalesce("comp", "p").alias("comp"))
    out = shared.write(out, name)
    shared.drop(f"edges{k}", *(f"jump{i}" for i in range(k)))
    return out
