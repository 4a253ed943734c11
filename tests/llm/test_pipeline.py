"""Every stage on a small input, held against a plain reading of what it does."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from loomline.llm import queries, secrets

BAD = {"idiot", "trash"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rnd, d = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    docs, labels = [], []
    for i in range(240):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(6, 60))]
        if i % 5 == 0:
            words[2] = rnd.choice(["idiot", "trash"])  # each in enough labelled rows to be learned
        labels.append((i, 1, int(i % 5 == 0)))
        if i % 11 == 3:
            words.append("token=abcdef1234567890abcdef")
        docs.append((i, " ".join(words), rnd.choice(["en", "de"]), f"src{i % 3}", 1))
    copy = docs[2][1].split()  # near copies, whose ids are greater
    copy = [*copy, *(f"w{rnd.randrange(400)}" for _ in range(60))]
    docs[2] = (2, " ".join(copy), "en", "src0", 1)
    docs += [(700 + k, " ".join([*copy[:-1], f"other{k}"]), "en", "src2", 1) for k in range(4)]
    docs += [(500 + i, docs[i][1], "en", "src1", 1) for i in range(1, 30)] + [(900, None, None, None, None), (901, "", "en", "src1", 0), (None, docs[1][1], "en", "src1", 1), (7, docs[7][1], "de", "src1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


#: Names that the stages use themselves.
ODD = ["m_note", "tox_toxic", "_text", "row", "h", "c0", "found", "copies", "doc", "n_shingles", "ids"]


def survivors(rows):
    """(id, text) of the rows that stay: one of each group that links of a Jaccard index of 0.8 make."""
    sets = []
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i] == rows[j] if not sets[i] else 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if same and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, r in sorted(zip(group, rows, strict=True), key=lambda x: (x[1].doc_id is None, x[1].doc_id or 0)):
        first.setdefault(g, (str(r.doc_id), str(r.text)))
    return sorted(first.values())


def test_one_id_with_two_texts(spark):
    rows = [(7, "a b c d e f", "en"), (7, "u v w x y z", "en"), (7, "a b c d e f", "de"), (None, "a b c d e f", "en"), (None, "k l m n o p", None), (3, None, None), (4, None, None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [p.drop_near_duplicates(spark, docs.repartition(n), "").collect() for n in (1, 5)]
    assert Counter(got[0]) == Counter(got[1])
    assert sorted((str(r.doc_id), str(r.text)) for r in got[0]) == [("3", "None"), ("4", "None"), ("7", "a b c d e f"), ("7", "u v w x y z"), ("None", "k l m n o p")]
    assert p.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ODD))
    columns, bad = docs.columns, BAD
    clean = p.drop_toxic(spark, docs, sf)
    assert clean.columns == columns
    want = [r for r in docs.collect() if not bad & set((r.text or "").split())]
    assert Counter(map(str, clean.collect())) == Counter(map(str, want))
    once = p.drop_near_duplicates(spark, clean, sf)
    assert once.columns == columns
    assert sorted((str(r.doc_id), str(r.text)) for r in once.collect()) == survivors(want)
    assert {str(r.doc_id) for r in once.collect()}.isdisjoint(map(str, range(700, 704)))
    safe = p.redact_secrets(spark, once, sf)
    assert safe.columns == columns and safe.count() == once.count()
    assert all(not secrets.base_spans(r.text or "") for r in safe.collect())
    mixed = p.mix_sources(spark, safe, sf)
    copies = {r.doc_id: r.copies for r in queries.mixed_documents(spark, safe).select("doc.doc_id", "copies").collect()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    tk = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted((str(r.doc_id), r.n_tokens) for r in p.encode_texts(spark, mixed, sf).collect())
    assert got == sorted((str(r.doc_id), len(tk.encode(r.text or "", add_special_tokens=False).ids)) for r in mixed.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in p.run(spark, sf).collect()) == got


def test_near_duplicates_from_80_percent(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(g, " ".join([*words, *(f"{g}x{k}" for k in range(n))])) for g, n in ((1, 12), (2, 12), (3, 40))]  # J = 96 / 120, and 96 / 148
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in p.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
