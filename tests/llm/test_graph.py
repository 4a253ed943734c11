import random

import pytest

from loomline.llm import common, graph


@pytest.mark.parametrize("hot", [0.05, 2.0])
def test_components_against_a_plain_search(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)  # hubs broadcast, and all merged
    rnd = random.Random(2)
    edges = [(7, 1000 + i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2016)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)]
    edges += [(1000, 5000), (5000, 5001), (5001, 3), (9, 9), (None, 4), (4, None), (7, 1000), (-5, 2010), (8, 2)]
    rnd.shuffle(edges)
    least = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = graph.components(df, common.Shared(spark)).collect()
    assert sorted((r.v, r.comp) for r in got) == sorted(least.items())
    assert graph.components(df.limit(0), common.Shared(spark)).count() == 0
