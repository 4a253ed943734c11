"""URL filters: fixed rules by host and path, and association rules mined from labelled URLs for the rest."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Least share of labelled URLs that a mined combination holds, and least share of its URLs with the rule's verdict.
SUPPORT, CONFIDENCE = 0.002, 0.8
#: Verdict where neither a fixed nor a mined rule fits.
DEFAULT = "allow"
_LABEL = "verdict="


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """Place of the longest rule that fits, from 0; null if none does. Of equally long ones the first listed wins."""
    out = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    for i in reversed(order):
        r = rules[i]
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host, its labels with their place from the top, path segments with their depth, the last segment's ending, query keys; numbers as their lengths. Their text grows with the URL's."""
    labels = F.reverse(F.split(host, r"\."))
    domains = F.concat(F.array(F.concat(F.lit("h:"), host)), F.transform(labels, lambda x, i: F.concat(F.lit("d"), i.cast("string"), F.lit(":"), x)))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: F.when(x.rlike(r"\A[0-9]+\z"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)
    parts = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), shape(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1))))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]*)://", 1)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)
    ends = F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(scheme, domains, parts, ends, keys))


def mine(labelled: DataFrame, shared: Shared, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules from labelled token sets (tokens array<string>, verdict string): rule, tokens, size, key, verdict, confidence, lift, support.

    A rule is pruned if a rule with fewer of its tokens has at least its confidence for the same verdict. key is the
    token of the fewest labelled URLs, by which an index lists the rule.

    Tokens below the support can't be in a rule and are left out of the transactions. Tokens of exactly the same URLs
    are mined as one: a rule with two of them would be pruned, and each stands in turn in the rules of the one. With d
    such classes of frequent tokens a URL at most, fewer than 2**d / support combinations are frequent, at any number
    of URLs.
    """
    rows = shared.write(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled")
    each = rows.select("row", "verdict", F.explode(F.array_distinct("tokens")).alias("token"))
    same = ("freq", "h1", "h2")
    single = each.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("h2"))
    single = single.where(F.col("freq") >= math.ceil(support * rows.count()))
    classes = shared.write(single.groupBy(*same).agg(F.array_sort(F.collect_list("token")).alias("members")).withColumn("item", F.col("members")[0]), "classes")
    # Fewer than d / support classes, d being the tokens of a URL.
    found = each.join(F.broadcast(classes.select("item")), each.token == F.col("item")).groupBy("row").agg(F.collect_list("item").alias("items"))
    items = rows.select("row", "verdict").join(found.hint("merge"), "row", "left")
    items = shared.write(items.select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit(_LABEL), "verdict")).alias("items")), "transactions")
    empty = "rule long, tokens array<string>, size int, key string, verdict string, confidence double, lift double, support double"
    if items.isEmpty():
        return shared.spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL)).where(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
    rules = shared.write(rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 1 << 20).alias("verdict"), "confidence", "lift", "support"), "rules")
    # A rule's shorter parts with one token less, met by an equi-join on their text.
    text = lambda c: F.array_join(c, "\x01")
    less = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("out")).withColumn("part", text(F.array_remove(F.col("tokens"), F.col("out"))))
    short = rules.select(text("tokens").alias("part"), "verdict", F.col("confidence").alias("shorter"))
    beaten = less.join(short, ["part", "verdict"]).where("shorter >= confidence").select("tokens", "verdict").distinct()
    kept = rules.join(beaten, ["tokens", "verdict"], "left_anti")
    # Every choice of one token from each class.
    lists = kept.select("tokens", "verdict", F.explode("tokens").alias("item")).join(classes.select("item", "members"), "item").groupBy("tokens", "verdict").agg(F.collect_list("members").alias("lists"))
    start = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("lists", start, lambda done, m: F.flatten(F.transform(done, lambda d: F.transform(m, lambda t: F.array_append(d, t)))))
    kept = kept.join(lists, ["tokens", "verdict"]).withColumn("tokens", F.explode(choices)).drop("lists").withColumn("tokens", F.array_sort("tokens"))
    ids = shared.write(kept.withColumn("rule", F.xxhash64(text("tokens"), "verdict")), "chosen")
    single = classes.select(F.explode("members").alias("token"), "freq")
    rarest = ids.select("rule", F.explode("tokens").alias("token")).join(single, "token").groupBy("rule").agg(F.min(F.struct("freq", "token")).alias("m"))
    out = ids.join(rarest, "rule").select("rule", "tokens", F.size("tokens").alias("size"), F.col("m.token").alias("key"), "verdict", "confidence", "lift", "support")
    return shared.write(out, "mined")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Returns id_col, host, path, rule, verdict, mined (tokens of the deciding mined rule) for every row of pages.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's; the longest
    wins. The URLs that rules fit are the labels from which FP-growth mines token combinations; a URL that no rule
    fits meets the mined rules by an inverted index of their rarest tokens, and of those with all tokens there the one
    with the most confidence, then support, then the fewest tokens decides. Without one the verdict is DEFAULT.

    Null URLs and those without :// have an empty host and path, and no tokens but the empty scheme. Repeated rows and
    ids, also null ids, give a row each; extra columns are left out.
    """
    shared = Shared(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    src = src.withColumn("at", fitting(rules, F.col("host"), F.col("path"))).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    lists = lambda what: F.array(*(F.lit(getattr(r, what)) for r in rules)) if rules else F.array().cast("array<string>")
    src = src.withColumn("rule", F.get(lists("text"), "at")).withColumn("fixed", F.get(lists("verdict"), "at"))
    every = shared.write(src.drop("url", "at").withColumn("row", F.monotonically_increasing_id()), "urls")
    mined = mine(every.where("fixed is not null").select("tokens", F.col("fixed").alias("verdict")), shared, support, confidence)
    index = mined.select(F.col("key").alias("token"), F.col("tokens").alias("need"), "size", F.col("verdict").alias("v"), "confidence", "support")
    open_ = every.where("fixed is null").select("row", "tokens", F.explode("tokens").alias("token"))
    hits = open_.join(index, "token").where(F.size(F.array_except("need", "tokens")) == 0)
    best = hits.groupBy("row").agg(F.max(F.struct("confidence", "support", (-F.col("size")).alias("size"), "v", F.array_join("need", " ").alias("need"))).alias("b"))
    best = shared.write(best.select("row", F.col("b.v").alias("v"), F.col("b.need").alias("mined")), "best")
    return every.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", "v", F.lit(DEFAULT)).alias("verdict"), "mined")
