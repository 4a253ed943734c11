import random

import pytest

from loomline.llm import minhash
from loomline.llm.graph import components
from loomline.llm.common import Shared, shingle_set


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((str(a), len(s), str(c := None if a is None else find(a) if s or a in root else a), a is not None and a == c) for (a, _), s in zip(rows, sets))


def run(spark, rows, **more):
    df = spark.createDataFrame([(a, t, "x", 1) for a, t in rows], "doc_id long, text string, v string, component_id int")
    return sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in minhash.near_duplicates(df, **more).collect())


def corpus(seed):
    rnd, rows = random.Random(seed), []
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(300))
    passage = [word() for _ in range(60)]
    for g in range(14):
        base = [word() for _ in range(rnd.choice([3, 6, 30, 45, 52, 60, 150, 600]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rnd.choice([1, 2, 5, 40 if g == 2 else 3])):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w) if rnd.random() < 0.8 else "\n".join(w).upper())
    rows += [None, "", " \t ", "One", "one", "a b c d", "A B c d", " ".join(passage), " ".join(passage) + " end"]
    rnd.shuffle(rows)
    return [*enumerate(rows), (None, rows[0]), (None, rows[1]), (0, rows[0])]


@pytest.mark.parametrize(("seed", "pivots"), [(1, 2), (2, 2), (3, 1)])
def test_against_brute_force(spark, seed, pivots, monkeypatch):
    if seed > 1:  # long lists, several blocks, before and after pivots
        monkeypatch.setattr(minhash, "SHORT", 2)
        monkeypatch.setattr(minhash, "BLOCK", 8)
        monkeypatch.setattr(minhash, "PIVOTS", pivots)
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_id_with_two_texts_and_empty_table(spark):
    rows = [(3, "a b c d e f"), (3, "u v w x y z"), (1, "u v w x y z"), (5, "A b c d e f")]
    assert run(spark, rows) == [("1", 2, "1", True), ("3", 2, "1", False), ("3", 2, "1", False), ("5", 2, "1", False)]
    assert run(spark, []) == []


def test_ids_that_are_no_numbers(spark):
    rows = [("5", "a b c d e f"), ("x", "a b c d e f"), ("7", "A b c d e f")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == [("5", 5, True), ("7", 5, False), ("None", None, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3), (100, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Shared(spark)).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 150, 200), 100)}


def links(rows, percent):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, t in rows for w in [t.split()]]
    return {(i, j) for i, s in sets for j, t in sets if i < j and 100 * len(s & t) >= percent * len(s | t)}


def grown(text, n, rnd):
    """n more words, each of which makes a shingle of low hash."""
    words = text.split()
    for _ in range(n):
        words.append(min((f"g{rnd.randrange(10**9)}" for _ in range(60)), key=lambda w: shingle_set(" ".join([*words[-4:], w]))[0]))
    return " ".join(words)


def test_pairs_at_80_against_brute_force(spark):
    rnd, rows = random.Random(5), []
    for g in range(40):
        base = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(100))
        # 96 common shingles and 2n of one text alone: from J = 0.75 to 0.86; in every second pair those are the least of all.
        n = rnd.choice([8, 10, 11, 12, 13, 16])
        more = (lambda: grown(base, n, rnd)) if g % 2 else (lambda: base + "".join(f" v{rnd.randrange(10**6)}" for _ in range(n)))
        rows += [(2 * g, more()), (2 * g + 1, more())]
    want = links(rows, 80)
    assert want > links(rows, 85)
    assert {(c, int(i)) for i, _, c, _ in run(spark, rows, percent=80) if i != c} == {(str(i), j) for i, j in want}
