"""MinHash near-duplicates: bottom-k sketches from one hash function, inverted lists, exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_map, join_counted, shingle_set
from .graph import components

#: Retained values of a sketch.
K = 48
#: Most probability with which a pair that just links is missed; sets of up to K shingles are their own sketches and lose nothing.
MISS = 4e-7
#: Sets of a list whose pairs are met by a join; longer lists are compared in blocks.
SHORT = 16
#: Sets of an inverted list that one task compares with as many others.
BLOCK = 512
#: Members of a longer list, one after another, that all others are compared with before blocks are.
PIVOTS = 2
#: Parts that the pairs of one set are dealt to.
SALTS = 1024
#: Cells of a dense block of sets that are multiplied at once.
_CELLS = 4_000_000


@cache
def least_shared(pct: int) -> int:
    """The most t for which two sets with a Jaccard index of pct % share fewer than t of the K least values of their union with a probability of MISS at most (binomial tail)."""
    j, tail, t = pct / 100, 0.0, 0
    while t < K and (tail := tail + math.comb(K, t) * j**t * (1 - j) ** (K - t)) <= MISS:
        t += 1
    return t


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """id, n_shingles, k1, k2 (128-bit key of the whole set, null if empty), sketch array<long> (ascending), t (hash of the text)."""
    src = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("t"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, key, sk = [], [], []
        for t in b.column(1).to_pylist():
            s = shingle_set(t, size)
            n.append(len(s))
            d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            key.append(d and (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            sk.append(s[:K].astype(np.int64))
        ends = np.cumsum([0, *map(len, sk)])
        flat = np.concatenate(sk) if sk else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array([k and k[0] for k in key], pa.int64()), pa.array([k and k[1] for k in key], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), b.column(2)],
            names=["id", "n_shingles", "k1", "k2", "sketch", "t"],
        )

    return arrow_map(src, run, "id long, n_shingles long, k1 long, k2 long, sketch array<long>, t long")


def _threshold(n: Column, pct: int) -> Column:
    """How many values of its sketch a set of n shingles shares at least with any set that it links with.

    Sets of up to pct % of K link with sets of up to K shingles only, whose sketches are whole.
    """
    return F.when(n * 100 <= K * pct, F.ceil(n * pct / F.lit(100.0))).otherwise(F.lit(least_shared(pct))).cast("int")


def _prefixes(nodes: DataFrame, pct: int, shared: Shared) -> DataFrame:
    """rep, n, sketch, vs: the rarest of a set's values, those left out that no other set retains.

    Values are put in order of how many sets retain them, rarest first. Two sets that share at least t of their
    values share one of the first size - t + 1 of each, so only these are listed, and what many documents have in
    common comes last.
    """
    each = nodes.select("rep", F.explode("sketch").alias("v"))
    counts = shared.write(each.groupBy("v").agg(F.count("*").alias("cnt")), "counts")
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first().n
    first = F.size("sketch") - _threshold(F.col("n"), pct) + 1
    ranked = join_counted(each, counts.where("cnt > 1"), ["v"], "cnt", total).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("cnt", "v"))).alias("vs"))
    ranked = ranked.join(nodes.select("rep", "n", "sketch", first.alias("first")), "rep")
    left = F.greatest(F.lit(0), F.col("first") - F.size("sketch") + F.size("vs"))
    ranked = ranked.select("rep", "n", "sketch", F.slice(F.transform("vs", lambda x: x.v), F.lit(1), left).alias("vs")).where(F.size("vs") > 0)
    out = shared.write(ranked, "prefixes")
    shared.drop("counts")
    return out


def _lists(prefixes: DataFrame, shared: Shared) -> tuple[DataFrame, int]:
    """Inverted lists of two sets and more: v, cnt, rep, i (v's place in rep's prefix). And how many entries there are."""
    heads = prefixes.select("rep", F.posexplode("vs").alias("i", "v"))
    sizes = shared.write(heads.groupBy("v").agg(F.count("*").alias("cnt")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first().n
    return shared.write(join_counted(heads, sizes.where("cnt > 1"), ["v"], "cnt", total), "lists"), total


def _with_sketch(lists: DataFrame, prefixes: DataFrame) -> DataFrame:
    """earlier: what comes before v in rep's prefix."""
    return lists.join(prefixes.hint("merge"), "rep").withColumn("earlier", F.expr("slice(vs, 1, i)")).drop("vs", "i")


def _estimated(pairs: DataFrame, pct: int) -> DataFrame:
    """Of pairs with n and sketch of a and b: those whose sketches allow a link."""
    t, whole = least_shared(pct), F.greatest("n_a", "n_b") <= K
    pairs = pairs.where(f"least(n_a, n_b) * 100 >= {pct} * greatest(n_a, n_b)").withColumn("both", F.array_intersect("sketch_a", "sketch_b"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, K)
    pairs = pairs.where(F.when(whole, F.size("both") * (100 + pct) >= pct * (F.col("n_a") + F.col("n_b"))).otherwise(F.size("both") >= t))
    return pairs.where(whole | (F.size(F.array_intersect(union, "both")) >= t))


def _short_pairs(rows: DataFrame, pct: int) -> DataFrame:
    """Candidate pairs a, b of lists of up to SHORT sets: each row meets fewer than SHORT others."""
    side = lambda x: rows.select("v", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "sketch", "earlier")))
    pairs = side("a").join(side("b"), "v").where("rep_a < rep_b").where("not arrays_overlap(earlier_a, earlier_b)")
    return _estimated(pairs, pct).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _pivot_pairs(rows: DataFrame, pct: int, turn: int, total: int) -> DataFrame:
    """Candidate pairs a, b of each list's pivot, its first member by a hash, with its members of other classes.

    rows: v, cnt, rep, n, sketch, comp. Lists of like members have the same pivot, so a pair is met once.
    """
    first = F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("h"), "rep", "n", "sketch", "comp"))
    pivots = rows.groupBy("v").agg(first.alias("p"), F.count("*").alias("members"))
    pivots = pivots.select("v", "members", *(F.col(f"p.{c}").alias(f"{c}_a") for c in ("rep", "n", "sketch", "comp")))
    mine = rows.select("v", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "sketch", "comp")))
    pairs = join_counted(mine, pivots, ["v"], "members", total).where("comp_a <> comp_b")
    return _estimated(pairs, pct).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, pct: int, size: int, shared: Shared, name: str) -> DataFrame:
    """Those of the pairs a, b whose whole sets link. A set in many pairs is dealt out with some of them each."""
    pairs = shared.write(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("s")), f"pairs{name}")
    texts = _texts(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), nodes, docs, shared, name)
    left = pairs.select("a", "s").distinct().join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = pairs.join(left, ["a", "s"]).join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    out = shared.write(arrow_map(both.select("a", "b", "text_a", "text_b"), _linked(pct, size), "a long, b long"), f"links{name}")
    shared.drop(f"pairs{name}", f"texts{name}")
    return out


def _texts(reps: DataFrame, nodes: DataFrame, docs: DataFrame, shared: Shared, name: str) -> DataFrame:
    """rep, t, text of these sets, one row for each."""
    wanted = shared.write(nodes.join(reps.hint("merge"), "rep", "left_semi").select("rep", "t"), "wanted")
    out = shared.write(docs.join(wanted.hint("merge"), ["rep", "t"], "left_semi").select("rep", "t", "text").dropDuplicates(["rep", "t"]), f"texts{name}")
    shared.drop("wanted")
    return out


def _linked(pct: int, size: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out, known = [], {}
        for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k, t in ((i, x), (j, y)):
                if k not in known or known[k][0] != t:
                    known[k] = (t, shingle_set(t, size))
            s, t = known[i][1], known[j][1]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= pct * (len(s) + len(t) - both):
                out.append((i, j))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _blocks(rows: DataFrame, total: int) -> DataFrame:
    """Deals a list's rows to pairs of blocks (p, q), p <= q; side 0, 1 or 2 (both).

    rows: v, cnt, rep, comp and more. Members of the list's largest class (known so far) are in blocks of their own,
    which meet the other blocks but not each other, so the work grows with the members outside of it times all.
    Lists of a single class are done.
    """
    sizes = rows.groupBy("v", "comp").agg(F.count("*").alias("m")).groupBy("v").agg(F.max(F.struct("m", "comp")).alias("x"), F.sum("m").alias("members"))
    sizes = sizes.where("members > x.m").select("v", "members", F.col("x.comp").alias("big"), F.ceil((F.col("members") - F.col("x.m")) / F.lit(float(BLOCK))).cast("int").alias("others"), F.ceil(F.col("x.m") / F.lit(float(BLOCK))).cast("int").alias("bigs"))
    dealt = join_counted(rows, sizes, ["v"], "members", total)
    of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    inside = F.col("comp") == F.col("big")
    dealt = dealt.withColumn("mine", F.when(inside, F.col("others") + of("bigs")).otherwise(of("others")))
    dealt = dealt.withColumn("other", F.explode(F.when(inside, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("bigs") - 1))))
    dealt = dealt.withColumn("p", F.least("mine", "other")).withColumn("q", F.greatest("mine", "other")).withColumn("side", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1))
    return dealt.drop("mine", "other", "big", "others", "bigs", "members")


def _pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two sides that are compared."""
    both = np.flatnonzero(side == 2)
    return (both, both) if len(both) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def _overlaps(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of lists a with lists b; the matrix is multiplied in pieces of bounded size."""
    out = np.zeros((len(a), len(b)), np.float32)
    own = np.concatenate([lists[i] for i in np.unique(np.concatenate([a, b]))])
    vals, cnt = np.unique(own, return_counts=True)
    vals = vals[cnt > 1]
    step = max(64, _CELLS // max(1, len(a) + len(b)))
    for at in range(0, len(vals), step):
        part = vals[at : at + step]

        def rows(which: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(which), len(part)), np.float32)
            for r, i in enumerate(which):
                x = lists[i]
                x = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
                pos = np.searchsorted(part, x)
                m[r, pos[part[pos] == x]] = 1
            return m

        out += rows(a) @ rows(b).T if a is not b else (m := rows(a)) @ m.T
    return out


def _candidates(pct: int):
    """Of each block pair: the rows that take part in at least one candidate pair."""
    t = least_shared(pct)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = _pairs(f.side.to_numpy())
        if not len(a) or not len(b):
            return f.iloc[:0][["v", "p", "q", "side", "rep", "comp", "earlier"]]
        n = f.n.to_numpy(np.float64)
        sk = [np.asarray(x, np.int64) for x in f.sketch]
        ok = np.minimum(n[a][:, None], n[b][None, :]) * 100 >= pct * np.maximum(n[a][:, None], n[b][None, :])
        # The union's K least values hold those of the intersection that are at most the K-th of the union.
        both = _overlaps(sk, a, b)
        need = np.where(np.maximum(n[a][:, None], n[b][None, :]) <= K, pct / (100.0 + pct) * (n[a][:, None] + n[b][None, :]) - 1e-6, float(t))
        ok &= both >= need
        ok &= _first_here(f.earlier, a, b)
        comp = f.comp.to_numpy()
        ok &= comp[a][:, None] != comp[b][None, :]
        for i, j in zip(*np.nonzero(ok & (both < need.max() + K)), strict=True):
            x, y = sk[a[i]], sk[b[j]]
            if max(n[a[i]], n[b[j]]) > K:
                u = np.union1d(x, y)[:K]
                if np.isin(u, x, assume_unique=True).sum() + np.isin(u, y, assume_unique=True).sum() - len(u) < t:
                    ok[i, j] = False
        live = np.zeros(len(f), bool)
        live[a[ok.any(axis=1)]] = True
        live[b[ok.any(axis=0)]] = True
        return f[live][["v", "p", "q", "side", "rep", "comp", "earlier"]]

    return run


def _first_here(earlier: pd.Series, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where two rows share no earlier value: another list has those that do."""
    return _overlaps([np.sort(np.asarray(x, np.int64)) for x in earlier], a, b) == 0


def _verified(pct: int, size: int):
    """Exact links of each block pair, as edges of a spanning forest of the block's links."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = _pairs(f.side.to_numpy())
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [shingle_set(t, size).astype(np.int64) for t in f.text]
        n = np.array([len(s) for s in sets], np.float64)
        inter = _overlaps(sets, a, b).astype(np.float64)
        ok = 100 * inter >= pct * (n[a][:, None] + n[b][None, :] - inter)
        ids, comp = f.rep.to_numpy(), f.comp.to_numpy()
        ok &= comp[a][:, None] != comp[b][None, :]
        root = list(range(len(f)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for i, j in zip(*np.nonzero(ok & _first_here(f.earlier, a, b)), strict=True):
            x, y = find(a[i]), find(b[j])
            if x != y:
                root[x] = y
                edges.append((ids[a[i]], ids[b[j]]))
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5) -> DataFrame:
    """Returns id_col, n_shingles, component_id, kept for every row of docs.

    A text's set holds its distinct shingles of `size` words (words: [^\\x20\\x09-\\x0D]+ with A-Z lower-cased); the
    whole sequence is the one shingle of a shorter text. Two texts link if 100 * intersection >= percent * union of
    their whole sets (percent of 80 or more). component_id is the least id that links reach, the own one included;
    kept: it is the own one.

    Method: equal sets are one node from the start. Each node keeps the K least hashes of its set. Inverted lists of
    retained values, rarest first, meet candidates; their overlap, then the estimate from the K least values of the
    union, filter; the Jaccard index of the whole sets decides. Pairs of lists of up to SHORT sets are joined. In a
    longer list PIVOTS members in turn are compared with all others, so a group of near copies takes about as many
    comparisons as it has members; what is not yet of one class is compared in blocks of BLOCK x BLOCK with matrix
    products, a pair in the first list it shares only, and blocks emit spanning forests, never all pairs.

    What is joined grows with the documents, so it is merged at every size; only values that more than 1 / 4096 of all
    entries have, so fewer than 4096, are broadcast.

    Null and empty texts and those of white space alone have an empty set: n_shingles 0, component_id the own id.
    A row with an id that is null or no whole number links with nothing, is not kept, and comes back without one. Rows with one id are one vertex. Extra columns are left out.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    shared = Shared(docs.sparkSession)
    every = shared.write(sketches(docs, id_col, text_col, size), "sketches")
    full = every.where("id is not null and k1 is not null")
    least = F.min(F.struct("id", "t"))
    nodes = full.groupBy("k1", "k2").agg(least.alias("m"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = shared.write(nodes.select("k1", "k2", F.col("m.id").alias("rep"), F.col("m.t").alias("t"), "n", "sketch"), "nodes")
    texts = docs.select(F.col(id_col).try_cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    prefixes = _prefixes(nodes, percent, shared)
    lists, total = _lists(prefixes, shared)
    short = shared.write(_short_pairs(_with_sketch(lists.where(f"cnt <= {SHORT}"), prefixes), percent), "short")
    long = shared.write(_with_sketch(lists.where(f"cnt > {SHORT}"), prefixes), "long")
    shared.drop("sizes", "lists", "prefixes")
    links = None
    rows = long.withColumn("comp", F.col("rep"))
    for turn in range(PIVOTS):
        pairs = _pivot_pairs(rows, percent, turn, total)
        new = _links(pairs.union(short) if not turn else pairs, nodes, texts, percent, size, shared, f"{turn}")
        links = new if links is None else links.union(new)
        comp = components(links, shared, f"classes{turn}")
        rows = long.join(comp.select(F.col("v").alias("rep"), "comp").hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    kinds = "v long, p int, q int, side int, rep long, comp long, earlier array<long>"
    live = shared.write(_blocks(rows, total).groupBy("v", "p", "q").applyInPandas(_candidates(percent), kinds), "candidates")
    rest = live.join(_texts(live.select("rep").distinct(), nodes, texts, shared, "rest"), "rep")
    links = shared.write(links.union(rest.groupBy("v", "p", "q").applyInPandas(_verified(percent, size), "a long, b long")), "links")
    shared.drop("candidates", "short", "long", "textsrest", *(f"{x}{k}" for k in range(PIVOTS) for x in ("links", "classes")))
    # Sets with one id are one vertex.
    twice = full.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x <> y").select("id")
    twice = full.join(twice, "id", "left_semi").select("id", "k1", "k2").join(nodes.select("k1", "k2", "rep"), ["k1", "k2"])
    comp = components(links.union(twice.select("rep", "id")), shared)
    shared.drop("links")
    named = nodes.join(comp.select(F.col("v").alias("rep"), "comp"), "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("comp"))
    named = shared.write(named, "classes")
    shared.drop("nodes", "components")
    out = full.join(named.hint("merge"), ["k1", "k2"], "left").select("id", "n_shingles", F.least(F.coalesce("comp", "id"), "id").alias("component_id"))
    rest = every.where("id is null or k1 is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
