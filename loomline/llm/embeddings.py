"""Embedding near-duplicates: an inverted multi-index over codebooks of vector halves."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_map, hash_sample
from .graph import components

#: Vectors, in the order of a hash, from which codebooks and the length of the traversal are learned.
SAMPLE = 20_000
#: Vectors that a cell holds on average.
PER_CELL = 64
#: Share of neighbours at exactly the threshold whose cell the traversal must reach.
RECALL = 0.98
#: Vectors of a cell that one task compares with as many visitors.
BLOCK = 1024


@dataclass
class Index:
    """Codebooks of the two halves and the number of product cells that a vector visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return x[:, :half], x[:, half:]


def _dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _dist(x, c).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_cells(dl: np.ndarray, dr: np.ndarray, count: int) -> list[int]:
    """Multi-sequence traversal: cells i * K + j by ascending dl[i] + dr[j], from the two sorted lists alone."""
    a, b = np.argsort(dl, kind="stable"), np.argsort(dr, kind="stable")
    heap, seen, out = [(float(dl[a[0]] + dr[b[0]]), 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(dr) + int(b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(dl) and y < len(dr) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(dl[a[x]] + dr[b[y]]), x, y))
    return out


def visited(index: Index, x: np.ndarray) -> np.ndarray:
    """The cells of each vector in the traversal's order; the first is its own. The pairs that a traversal can reach
    in so many steps are those with (i + 1) * (j + 1) <= steps in the sorted lists; the least of these are taken at once."""
    l, r = _split(x)
    dl, dr = _dist(l, index.left), _dist(r, index.right)
    k, steps = (min(d.shape[1], index.visits) for d in (dl, dr)), index.visits
    a, b = (np.argsort(d, 1, kind="stable")[:, :n] for d, n in zip((dl, dr), k, strict=True))
    times = np.minimum(steps // np.arange(1, a.shape[1] + 1), b.shape[1])
    i, j = np.repeat(np.arange(len(times)), times), np.concatenate([np.arange(n) for n in times])
    sums = np.take_along_axis(dl, a, 1)[:, i] + np.take_along_axis(dr, b, 1)[:, j]
    best = np.argsort(sums, 1, kind="stable")[:, :steps]
    rows = np.arange(len(x))[:, None]
    return (a[rows, i[best]] * dr.shape[1] + b[rows, j[best]]).astype(np.int64)


def learn(sample: np.ndarray, n: int, threshold: float, seed: int = 1) -> Index:
    """Codebooks for n vectors from a sample of unit vectors.

    The traversal is as long as RECALL of neighbours need that are put in random directions from the sample's vectors
    at the threshold itself, the farthest that links may be. Cells grow in number with n up to a quarter of the
    sample's vectors a half, so of a sample of 20,000 they hold PER_CELL vectors each up to 1.6 billion vectors.
    """
    k = int(np.clip(round((n / PER_CELL) ** 0.5), 1, max(1, len(sample) // 4)))
    l, r = _split(sample)
    index = Index(_kmeans(l, k, seed), _kmeans(r, k, seed + 1), 1)
    rnd = np.random.default_rng(seed)
    x = sample[rnd.choice(len(sample), min(len(sample), 2000), replace=False)]
    noise = rnd.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    home = visited(index, threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * noise)[:, 0]
    dl, dr = (_dist(p, c) for p, c in zip(_split(x), (index.left, index.right), strict=True))
    mine = dl[np.arange(len(x)), home // k] + dr[np.arange(len(x)), home % k]
    rank = np.zeros(len(x), np.int64)
    dr.sort(1)  # how many cells are nearer: for each left centroid, the right ones below what is left
    for at in range(len(x)):
        rank[at] = np.searchsorted(dr[at], mine[at] - 1e-12 - dl[at]).sum()
    index.visits = int(np.quantile(rank, RECALL, method="higher")) + 1
    return index


def _valid(b: pa.RecordBatch) -> pa.RecordBatch:
    keys, dims, vectors = [], [], []
    for v in b.column(1).to_pylist():
        ok = v and None not in v
        x = np.asarray(v, np.float64) if ok else np.empty(0)
        most = np.abs(x).max(initial=0)
        ok = ok and 0 < most < np.inf
        if ok and b.schema.field(1).type.value_type == pa.float64():
            # By a power of two, which is exact; then no square is too large or too small. Floats' squares never are.
            x = np.ldexp(x, -int(np.frexp(most)[1]))
        keys.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
        dims.append(len(x) if ok else 0)
        vectors.append(x if ok else None)
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, b.schema.field(1).type), pa.array(keys, pa.binary()), pa.array(dims, pa.int32())], names=["id", "x", "key", "dim"])


def _units(lists: list) -> np.ndarray:
    x = np.asarray(lists, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(threshold: float):
    """Links of a block of a cell's members with a block of its visitors: id, links, comp.

    A pair found both ways (each visits the other's cell) counts once for each vector: a visitor always counts its
    links, a member only those with visitors whose own cell it doesn't visit.
    """

    none = pd.DataFrame({"key": [], "id": [], "links": [], "comp": []}).astype({"id": "int64", "links": "int64", "comp": "int64"})

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f["code"] = pd.factorize(f.key)[0]
        m, v = f[f.side == 0], f[f.side == 1]
        if m.empty or v.empty:
            return none
        links = _units(v.x.tolist()) @ _units(m.x.tolist()).T >= threshold
        links &= v.code.to_numpy()[:, None] != m.code.to_numpy()[None, :]
        rows, cols = links.any(1), links.any(0)
        m, v, links = m[cols], v[rows], links[np.ix_(rows, cols)]
        if m.empty:
            return none
        mid, vid, mn, vn = m.id.to_numpy(), v.id.to_numpy(), m.n.to_numpy(), v.n.to_numpy()
        found = (links * mn[None, :]).sum(1)
        goes, home, back = np.stack(m.cells.tolist()), v.home.to_numpy(), np.zeros(len(m), np.int64)
        for h in np.unique(home):
            rows = home == h
            once = ~(goes == h).any(1)
            back[once] += (links[np.ix_(rows, once)] * vn[rows][:, None]).sum(0)
        a, b = vid.copy(), mid.copy()
        while True:
            a2 = np.minimum(a, np.where(links, b[None, :], np.iinfo(np.int64).max).min(1))
            b2 = np.minimum(b, np.where(links, a2[:, None], np.iinfo(np.int64).max).min(0))
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
        return pd.DataFrame({"key": [*v.key, *m.key], "id": np.concatenate([vid, mid]), "links": np.concatenate([found, back]).astype(np.int64), "comp": np.concatenate([a, b])})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Returns id_col, n_links, component_id, kept for every row of vectors.

    Two rows link if the cosine of their vectors, in double precision, is found to be threshold or more. Codebooks of
    the two halves are learned from SAMPLE vectors at most; their product is a grid of cells that holds every vector.
    Each vector visits the nearest cells in the order of the multi-sequence traversal, as many as RECALL of
    neighbours at the threshold need, and is compared with all members; pairs met from either side count once. Equal
    vectors are one entry with a multiplicity, so copies need no comparison. Cells are dealt in blocks of
    BLOCK x BLOCK; a block returns a sum and a label for each vector, never pairs.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; those of unlike
    lengths don't link. Vectors of any finite length count: doubles are scaled by powers of two, arrays of floats stay
    as they are. A row with an id that is null or no whole number counts for nobody and gets 0 links. Rows with one id are one
    vertex; their links are each row's own. Extra columns are left out; an empty table gives an empty result.
    """
    shared = Shared(vectors.sparkSession)
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    src = vectors.select(F.col(id_col).try_cast("long").alias("id"), F.col(vector_col).cast(kind).alias("x"))
    every = shared.write(arrow_map(src, _valid, f"id long, x {kind}, key binary, dim int"), "vectors")
    good = every.where("key is not null and id is not null")
    nodes = shared.write(good.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("x").alias("x")), "entries")
    found = []
    for dim, n in sorted((r.dim, r["count"]) for r in nodes.groupBy("dim").count().collect()):
        found.append(_search(nodes.where(F.col("dim") == dim), n, threshold, shared, str(dim)))
    links = nodes.select("key", "id", F.lit(0).cast("long").alias("links"), F.col("id").alias("comp")).limit(0)
    for f in found:
        links = links.unionByName(f)
    edges = links.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
    twice = good.groupBy("id").agg(F.min("key").alias("p"), F.max("key").alias("q")).where("p <> q").select("id")
    twice = good.join(twice, "id", "left_semi").select(F.col("id").alias("a"), "key").join(nodes.select("key", "id"), "key").select("a", F.col("id").alias("b"))
    comp = components(edges.union(twice), shared)
    sums = links.groupBy("key").agg(F.sum("links").alias("links"))
    out = nodes.select("key", "id", "n").join(sums, "key", "left").join(comp.withColumnRenamed("v", "id").withColumnRenamed("comp", "c"), "id", "left")
    out = shared.write(out.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("c", "id").alias("c")), "found")
    named = good.select("id", "key").join(out.hint("merge"), "key", "left").select("id", F.col("links").alias("n_links"), F.least("c", "id").alias("component_id"))
    rest = every.where("key is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return named.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _search(nodes: DataFrame, n: int, threshold: float, shared: Shared, name: str) -> DataFrame:
    """key, id, links, comp of the entries of one length, from every block they are compared in."""
    sample = hash_sample(nodes.select("key", "x"), F.col("key"), SAMPLE).select("x").toArrow()
    index = learn(_units(sample.column(0).to_pylist()), n, threshold)

    def cells(b: pa.RecordBatch) -> pa.RecordBatch:
        c = visited(index, _units(b.column(1).to_pylist())) if b.num_rows else np.empty((0, 1), np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(c.ravel(), pa.int64()))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), flat], names=["key", "id", "cells"])

    at = shared.write(arrow_map(nodes.select("key", "x", "id"), cells, "key binary, id long, cells array<long>"), f"cells{name}")
    homes = at.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("members"))
    visits = at.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(float(BLOCK))).cast("int")
    sizes = shared.write(homes.join(visits, "cell").select("cell", blocks("members").alias("p_n"), blocks("visitors").alias("q_n")), f"sizes{name}")
    dealt = F.xxhash64("key")
    member = at.select("key", "cells", F.col("cells")[0].alias("cell"), F.col("cells")[0].alias("home"), F.lit(0).alias("side")).join(sizes, "cell")
    member = member.withColumn("p", F.pmod(dealt, "p_n").cast("int")).withColumn("q", F.explode(F.expr("sequence(0, q_n - 1)")))
    visit = at.select("key", F.explode("cells").alias("cell"), F.col("cells")[0].alias("home")).withColumn("side", F.lit(1)).join(sizes, "cell")
    visit = visit.withColumn("q", F.pmod(dealt, "q_n").cast("int")).withColumn("p", F.explode(F.expr("sequence(0, p_n - 1)"))).withColumn("cells", F.lit(None).cast("array<long>"))
    cols = ["key", "cell", "p", "q", "side", "home", "cells"]
    rows = member.select(*cols).unionByName(visit.select(*cols)).join(nodes.select("key", "id", "n", F.col("x")), "key")
    got = rows.select("cell", "p", "q", "side", "home", "cells", "key", "id", "n", "x").groupBy("cell", "p", "q").applyInPandas(_compare(threshold), "key binary, id long, links long, comp long")
    return shared.write(got.groupBy("key", "id", "comp").agg(F.sum("links").alias("links")).select("key", "id", "links", "comp"), f"links{name}")
