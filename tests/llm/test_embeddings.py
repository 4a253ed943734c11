import numpy as np
import pytest

from loomline.llm import embeddings as e


def vectors(seed=1, groups=30, dim=16):
    rnd = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rnd.standard_normal(dim)
        for _ in range(1 + g % 4):
            out.append((base + rnd.standard_normal(dim) * rnd.choice([0.03, 0.15])).astype(np.float32).tolist())
    out += [out[0], out[0], out[5], [2 * x for x in out[0]], None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [1.0, 0.0], [1.0, 0.1], [float("inf")] + [1.0] * (dim - 1)]
    return out


def brute(rows):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.asarray(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    n, root = [0] * len(rows), {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                n[i] += 1
                n[j] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((str(k), n[i], str(c := find(k)), k is not None and k == c) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("block", [e.BLOCK, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    monkeypatch.setattr(e, "PER_CELL", 4)
    monkeypatch.setattr(e, "RECALL", 1.0)
    v = vectors()
    rows = [*enumerate(v), (None, v[0])]
    df = spark.createDataFrame([(i, x, 3) for i, x in rows], "vec_id long, embedding array<float>, key int")
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in e.near_duplicates(df).collect())
    assert got == brute([(i, None if i is None else x) for i, x in rows])


def test_recall_and_traversal(spark):
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((1500, 32))
    x = np.concatenate([x, x[:700] + 0.2 * rnd.standard_normal((700, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = e.learn(x, len(x), 0.95)
    l, r = e._split(x)
    for row in range(0, 50):
        dl, dr = e._dist(l[row : row + 1], index.left)[0], e._dist(r[row : row + 1], index.right)[0]
        assert e.nearest_cells(dl, dr, index.visits) == e.visited(index, x[row : row + 1])[0].tolist()
    true = (x @ x.T >= 0.95).sum() - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in e.near_duplicates(df).collect())
    assert 0.9 * true <= found <= true


def test_empty(spark):
    assert e.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just over 0.95, where the index finds fewest."""
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rnd.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.9505 * x + np.sqrt(1 - 0.9505**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r.n_links for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i] > 0 for i in range(3000)) >= 0.95 * 3000


def test_lengths_and_ids(spark):
    rows = [("1", [1e200, 1e200]), ("2", [2e200, 2e200]), ("3", [3e-200, 3e-200]), ("4", [5e-324, 5e-324]), ("5", [1e200, -1e200]), ("x", [1.0, 1.0]), ("6", [0.0, 0.0]), ("7", [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), None: (0, None, False)}
    rows = [(1, [3e38, 3e38]), (2, [1.0, 1.0]), (3, [1e-40, 1e-40])]
    assert {r.n_links for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()} == {2}
