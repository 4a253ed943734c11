import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomline.llm import common, mixing

WEIGHTS = [("a", None, None, 5), ("b", None, None, 3), ("a", "en", None, 4), ("a", "en", "s1", 7), ("", None, None, 2)]


def share_out(budget, caps, weights):
    """Water filling, one full sibling after another."""
    open_, out = dict(caps), {}
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] * total <= weights[k] * budget]
        if not full:
            return out | {k: weights[k] * budget // total for k in open_}
        k = min(full, key=lambda x: (caps[x] / weights[x], x))
        out[k] = open_.pop(k)
        budget -= out[k]
    return out


def brute(rows, share, epochs):
    supply, weight = defaultdict(int), defaultdict(lambda: 1, {tuple(x for x in w[:3] if x is not None): w[3] for w in WEIGHTS})
    for _, d, l, s, t in rows:
        supply[d or "", l or "", s or ""] += len((t or "").split())
    cap = lambda p: sum(v * epochs for k, v in supply.items() if k[: len(p)] == p)
    budget = {(): min(cap(()), int(share * sum(supply.values())))}
    for depth in range(3):
        for p in [p for p in budget if len(p) == depth]:
            kids = {k[: depth + 1] for k in supply if k[:depth] == p}
            budget |= share_out(budget[p], {k: cap(k) for k in kids}, {k: weight[k] for k in kids})
    out = []
    for leaf, tokens in supply.items():
        e, rest = divmod(budget[leaf], tokens) if tokens else (0, 0)
        mine = [(hashlib.md5(f"1|{e}|{'' if i is None else i}".encode()).hexdigest(), i, len((t or "").split())) for i, d, l, s, t in rows if (d or "", l or "", s or "") == leaf]
        for key, i, _ in mine:
            out.append((str(i), e + (sum(n for k, _, n in mine if k <= key) <= rest)))
    return sorted(out)


@pytest.mark.parametrize("hot", [0.02, 1.0])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)  # leaves broadcast and merged, and merged alone
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "a", "b", None]), rnd.choice(["en", "de"]), rnd.choice(["s1", "s2", "s3"]), " ".join("w" for _ in range(rnd.choice([0, 1, 5, 40])))) for i in range(300)]
    rows += [(7, *rows[7][1:]), (None, "b", "en", "s9", "x y"), (500, "b", "fr", "s1", None)]
    rows += [(77, "a", "en", "s1", "x y")] * 100  # one id on a quarter of the rows
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, domain string, lang string, source string, text string, part int")
    weights = spark.createDataFrame(WEIGHTS, "domain string, language string, source string, w int")
    for share, epochs in ((0.6, 1), (1.5, 2), (9.0, 2)):
        got = sorted((str(r.doc_id), r.copies) for r in mixing.mix(df, weights, share, epochs).select("doc.doc_id", "copies").collect())
        assert got == brute(rows, share, epochs)
    out = mixing.mix(df, weights, 1.5, 2)
    assert mixing.taken(out).columns == df.columns
    assert mixing.taken(out).count() == out.agg(F.sum("copies")).first()[0]
    # Columns that share names with the operator's own.
    odd = ["m_note", "copies", "tokens", "doc", "language", "a.b", "n", "rest", "key", "m_copies"]
    clash = df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(odd)))
    got = mixing.taken(mixing.mix(clash, weights, 0.6, 1))
    assert got.columns == clash.columns and got.where("m_note <> 0 or copies <> 1 or key <> 8").count() == 0
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(i for i, n in brute(rows, 0.6, 1) for _ in range(n))
    assert mixing.mix(df.limit(0), weights, 0.5).count() == 0
