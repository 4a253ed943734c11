import math
import random
import re
import time

import numpy as np
import pytest

from loomline.llm import common, langid


def words(lang, rnd, n):
    syl = {"aa": ["ka", "ra", "mo", "ti"], "bb": ["sche", "lich", "ung", "ber"], "cc": ["ción", "ado", "que", "ña"]}[lang]
    return " ".join("".join(rnd.choice(syl) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def brute(rows, model):
    """The fusion, page by page."""
    n, out = len(model.langs), []
    scores, keys = [], []
    for _, url, page in rows:
        s = np.zeros(n)
        if t := langid.visible_text(page).strip():
            s = model.logp[:, langid.slots_of(t)].sum(1, dtype=np.float64) * langid.TEMPER
        host = url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
        parts = host.split(".")
        keys.append({"host": host, "domain": ".".join(parts[-2:]), "suffix": parts[-1], "declared": langid.declared_language(page)})
        scores.append(s)
    q = [np.exp(s - s.max()) / np.exp(s - s.max()).sum() for s in scores]
    mean = (sum(q) + 1 / n) / (len(rows) + 1)
    for i in range(len(rows)):
        def share(key, prior, i=i):
            same = [q[j] for j in range(len(rows)) if j != i and keys[j][key] == keys[i][key]]
            return (sum(same) + langid.PRIOR * prior) / (len(same) + langid.PRIOR)

        log = scores[i] + np.log(share("host", share("domain", mean)))
        for key in ("declared", "suffix"):
            if keys[i][key]:
                log = log + np.log(share(key, mean) / mean)
        p = np.exp(log - log.max())
        out.append((model.langs[int(log.argmax())], float(p.max() / p.sum())))
    return out


@pytest.mark.parametrize("hot", [0.05, 1.0])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, words(x, rnd, 40), x) for i, x in enumerate(["aa", "bb", "cc"] * 20)] + [(None, "x", "aa"), (99, None, "bb"), (100, "y", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.langs == ["aa", "bb", "cc"]
    rows = []
    for i in range(60):
        x = rnd.choice(["aa", "bb", "cc"])
        said = rnd.choice([f' lang="{x}-XX"', "", ' lang="aa"'])
        rows.append((i, f"http://{rnd.choice(['m.', ''])}{x}{i % 3}.site.{rnd.choice([x, 'com'])}/p", f"<html{said}><script>que</script><p>{words(x, rnd, rnd.choice([0, 1, 30]))}</p></html>"))
    rows += [(100, None, None), (101, "nonsense", ""), (None, *rows[0][1:]), (3, *rows[3][1:])]
    pages = spark.createDataFrame([(*r, 1.0) for r in rows], "page_id long, url string, html string, q0 double")
    got = langid.identify(pages, model).collect()
    want = brute(rows, model)
    assert sorted((str(r.page_id), r.lang, round(r.posterior, 6)) for r in got) == sorted((str(i), l, round(p, 6)) for (i, _, _), (l, p) in zip(rows, want, strict=True))
    assert all(math.isfinite(r.posterior) for r in got)


def test_declared_and_text():
    assert langid.declared_language('<!DOCTYPE html><HTML class="x" lang=de-AT>') == "de"
    assert langid.declared_language('<meta http-equiv="Content-Language" content="fr">') == "fr"
    assert langid.declared_language("<p lang=en>") == "" and langid.declared_language(None) == ""
    assert langid.visible_text("a<style>b</style><b>c &amp; d</b><!-- e -->").split() == ["a", "c", "&", "d"]


def test_scanner_is_linear_and_reads_as_the_pattern():
    drop = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.IGNORECASE | re.DOTALL)
    said = re.compile(r"""<(?:html|body)\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})\b|http-equiv\s*=\s*["']?content-language["']?\s+content\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.IGNORECASE)
    rnd = random.Random(2)
    bits = ["<!--", "-->", "<script", "<SCRIPT>", "</script >", "</style>", "<style>", "<b>", ">", "<", "text ", "<html", " lang=de", " xml:lang='fr'", "<body x", "http-equiv=content-language content=es ", "\n"]
    for _ in range(3000):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        assert langid.visible_text(page) == drop.sub(" ", page), page
        m = said.search(page)
        assert langid.declared_language(page) == ((m[1] or m[2]).lower() if m else ""), page
    start = time.time()
    for bit in ("<!--", "<script", "<html ", "<", "</script  ", "<html lang "):
        page = bit * (1_000_000 // len(bit))
        assert langid.visible_text(page).strip() == page.strip() and langid.declared_language(page) == ""
    assert time.time() - start < 10


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.b", "x")], "page_id long, url string, html string")
    assert langid.identify(pages, langid.learn(none)).collect()[0].lang is None
    docs = spark.createDataFrame([(1, "abc def", "aa")], none.schema)
    assert langid.identify(pages.limit(0), langid.learn(docs)).count() == 0
