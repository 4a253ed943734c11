"""Mixing sources to target weights: budgets down a tree of domain, language and source, and seeded token prefixes.

DataFrame and SQL functions only. Every step is exact integer arithmetic, so a run can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Shared, join_counted

#: Pattern of a token: a word.
WORD = "[^\\x20\\x09-\\x0D]+"
_BIG = "decimal(38,0)"


def _level(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of a level's nodes from their parents' (column budget), weights w and capacities cap.

    Siblings share a budget by weight. One whose share is over its capacity keeps its capacity, and the rest goes to
    its siblings by their weights, until none is over. In order of cap / w the full ones come first, so sums over that
    order tell them in one step. Shares are rounded down.
    """
    group = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(1))
    order = group.orderBy(F.col("cap").cast("double") / F.col("w"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    zero = F.lit(0).cast(_BIG)
    x = nodes.withColumn("rest_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)).withColumn("rest_w", F.sum("w").over(after))
    x = x.withColumn("full", F.col("cap") * F.col("rest_w") <= F.col("w") * F.col("rest_b"))
    first = F.when(~F.col("full"), 1)
    x = x.withColumn("open_b", F.max(F.when(first == 1, F.col("rest_b"))).over(group)).withColumn("open_w", F.max(F.when(first == 1, F.col("rest_w"))).over(group))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(w * open_b) div open_w"))
    return x.withColumn("budget", share.cast(_BIG)).drop("rest_b", "rest_w", "full", "open_b", "open_w")


def budgets(supply: DataFrame, weights: DataFrame, target: Column | int, epochs: int, shared: Shared) -> DataFrame:
    """domain, language, source, tokens, budget of every leaf.

    supply: domain, language, source, tokens. weights: domain, language, source (null at an inner node), w: positive
    whole numbers; a node that isn't listed weighs 1. A leaf's capacity is epochs times its tokens, an inner node's
    the sum of its leaves'; a budget that a node's leaves can't meet goes to its siblings before its parent's.
    """
    cap = F.sum("cap").cast(_BIG).alias("cap")
    leaves = shared.write(supply.withColumn("cap", (F.col("tokens") * epochs).cast(_BIG)), "leaves")
    top = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).cast(_BIG).alias("cap")).select(F.least("cap", F.lit(target).cast(_BIG)).alias("budget"))
    path = ["domain", "language", "source"]
    parent = None
    for k, name in enumerate(path):
        nodes = leaves.groupBy(*path[: k + 1]).agg(cap)
        w = weights.where(F.col(name).isNotNull() & (F.col(path[k + 1]).isNull() if k < 2 else F.lit(True))).select(*path[: k + 1], F.col("w").cast(_BIG).alias("w"))
        nodes = nodes.join(w, path[: k + 1], "left").withColumn("w", F.coalesce("w", F.lit(1).cast(_BIG)))
        # The root is one row; every other level's table of budgets is as small as the tree.
        nodes = nodes.crossJoin(F.broadcast(top)) if parent is None else nodes.join(parent.select(*path[:k], "budget"), path[:k])
        parent = shared.write(_level(nodes, path[:k], name), f"level{k}")
    return leaves.select(*path, "tokens").join(parent.select(*path, "budget"), path)


def mix(docs: DataFrame, weights: DataFrame, share: float, epochs: int = 2, seed: str = "1", id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, language: Column | None = None, source: Column | None = None, shared: Shared | None = None) -> DataFrame:
    """Every row of docs as `doc` (a struct of its own columns, whatever their names), with domain, language, source,
    tokens, copies: how often the row is taken, 0 for never.

    The target is `share` of all tokens (words), rounded down; budgets() spreads it over the tree. A leaf whose budget
    is e times its tokens and a rest takes every row e times, and for the rest the rows of epoch e in seeded order, the
    MD5 of seed, epoch and id, up to the last whose tokens still fit with those before it. Rows with one id in a leaf
    are tied and taken together.

    The order's cut is found by sums over 256 prefixes of the hash, then twice 256 longer ones within the prefix that
    the cut falls in, then ids; a leaf or an id with a third of all rows is summed on every task before any shuffle.
    The table of leaves joins by common.join_counted: leaves of many rows, of which there is a bounded number, are
    broadcast, so texts of these are not shuffled and no task gets a whole leaf.
    Null domains, languages and sources are nodes of their own (an empty name). Null and empty texts have 0 tokens and
    come with the prefix that they fall in. Repeated rows stay; an empty table gives an empty result.
    """
    shared = shared or Shared(docs.sparkSession)
    of = lambda c, name: F.coalesce((F.col(name) if c is None else c).cast("string"), F.lit(""))
    leaf = [of(domain, "domain").alias("domain"), of(language, "lang").alias("language"), of(source, "source").alias("source")]
    path = ["domain", "language", "source"]
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    narrow = shared.write(docs.select(*leaf, text_id.alias("id"), tokens.alias("tokens")), "narrow")
    supply = shared.write(narrow.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "supply")
    sums = supply.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    target = F.floor(F.lit(str(share)).cast("decimal(10,6)") * sums.t)
    plan = budgets(supply.drop("n"), weights, target, epochs, shared).join(supply.select(*path, "n"), path)
    e = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    plan = shared.write(plan.select(*path, "n", e.cast("int").alias("epoch"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("rest")), "plan")
    key = lambda i: F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), i).cast("binary"))
    keyed = shared.write(join_counted(narrow, plan, path, "n", sums.n).select(*path, "n", "rest", key(F.col("id")).alias("key"), "tokens"), "keyed")

    group = W.partitionBy(*path)

    def cut(rows: DataFrame, part: Column) -> DataFrame:
        """The first part of the order whose end is over the rest, with what is before it."""
        parts = rows.groupBy(*path, part.alias("part")).agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"), F.max("n").alias("n"))
        parts = parts.withColumn("upto", F.sum("t").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)))
        over = parts.where("upto > rest").groupBy(*path).agg(F.min(F.struct("part", "upto", "t", "rest", "n")).alias("x"))
        return over.select(*path, F.col("x.part").alias("part"), (F.col("x.rest") - F.col("x.upto") + F.col("x.t")).alias("left"), F.col("x.n").alias("n"))

    # Each step looks at 256 longer prefixes within the one that the cut falls in.
    short, at = keyed.select(*path, "key", "tokens"), None
    for digits in (2, 4, 6):
        if at is None:
            rows = keyed
        else:
            rows = join_counted(short, at, path, "n", sums.n).where(f"substring(key, 1, {digits - 2}) = part").select(*path, "n", "key", "tokens", F.col("left").alias("rest"))
        at = shared.write(cut(rows, F.substring("key", 1, digits)), f"cut{digits}")
    in2 = join_counted(short, at, path, "n", sums.n).where("substring(key, 1, 6) = part")
    in2 = in2.groupBy(*path, "part", "key").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("rest"))  # rows with one id are one
    upto = F.sum("tokens").over(W.partitionBy(*path, "part").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = in2.withColumn("upto", upto).where("upto <= rest").groupBy(*path).agg(F.max("key").alias("last"))
    ends = plan.join(at.drop("n"), path, "left").join(last, path, "left").select(*path, "n", "epoch", F.coalesce("last", "part", F.lit("~")).alias("end"))
    ends = shared.write(ends, "ends")

    named = docs.select(doc, *leaf, tokens.alias("tokens"), text_id.alias("id"))
    copies = (F.col("epoch") + F.when(key(F.col("id")) <= F.col("end"), 1).otherwise(0)).cast("int")
    return join_counted(named, ends, path, "n", sums.n).select("doc", *path, "tokens", copies.alias("copies"))


def taken(mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mix() takes it."""
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
