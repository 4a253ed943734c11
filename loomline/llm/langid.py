"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_map, hash_sample, join_counted, mixed

#: Labelled texts, by a hash of their ids, that the trigram model is learned from at most.
SAMPLE = 6_000
#: Slots that trigrams of bytes are hashed to.
SLOTS = 1 << 16
#: Neighbouring trigrams overlap, so each counts for this share of an independent one.
TEMPER = 0.25
#: Pages that a level of the host hierarchy, a declared language or a suffix must outweigh.
PRIOR = 5.0
#: Elements whose content isn't shown, and a declared language. Fixed values.
_HIDDEN = re.compile(r"<(script|style|noscript|template)\b", re.IGNORECASE)
_ROOT = re.compile(r"<(?:html|body)\b", re.IGNORECASE)
_LANG = re.compile(r"""\s(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.IGNORECASE)
_HTTP = re.compile(r"""http-equiv\s*=\s*["']?content-language["']?\s+content\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.IGNORECASE)


@dataclass
class Model:
    """Languages and the log probabilities of trigram slots, one row for each."""

    langs: list[str]
    logp: np.ndarray


def slots_of(text: str) -> np.ndarray:
    """Slots of a text's byte trigrams; A-Z lower-cased, runs of what isn't a letter are one space."""
    b = re.sub(rb"[\x00-@\[-`{-\x7f]+", b" ", text.encode("utf-8", "surrogatepass").lower())
    x = np.frombuffer(b" " + b + b" ", np.uint8).astype(np.uint64)
    tri = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    return (mixed(tri + np.uint64(0x51ED)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _shown(page: str) -> Iterator[str]:
    """What stands between comments, hidden elements and tags. What has no end isn't one: once an end is not found, it is not looked for again, so the steps grow with the page."""
    at, missing = 0, set()

    def after(what: str, start: int) -> int:
        if what in missing:
            return -1
        m = re.compile(what, re.IGNORECASE).search(page, start)
        if m is None:
            missing.add(what)
        return m.end() if m else -1

    while (i := page.find("<", at)) >= 0:
        end = after("-->", i + 4) if page.startswith("<!--", i) else -1
        if end < 0 and (m := _HIDDEN.match(page, i)):
            end = after(rf"</{m[1].lower()}\s*>", i)
        if end < 0:
            end = after(">", i)
        if end < 0:
            break
        yield page[at:i]
        at = end
    yield page[at:]


def visible_text(page: str | None) -> str:
    return html.unescape(" ".join(_shown(page))) if page else ""


def declared_language(page: str | None) -> str:
    """The language of the first html or body tag, or content-language header, that has one; empty without."""
    if not page:
        return ""
    other, at = _HTTP.search(page), 0
    while (m := _ROOT.search(page, at)) and (other is None or m.start() < other.start()):
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        if lang := _LANG.search(page, m.end(), end):
            return lang[1].lower()
        at = end
    return other[1].lower() if other else ""


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """The trigram model of a bounded sample of labelled texts; rows with null or empty labels, ids or texts don't take part."""
    good = docs.where(F.col(id_col).isNotNull() & (F.coalesce(lang_col, F.lit("")) != ""))
    ids = hash_sample(good.select(id_col), F.col(id_col), sample).distinct()
    rows = good.join(F.broadcast(ids), id_col, "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, slots, n = [], [], []
        col = b.column(0).to_pylist()
        for lang in sorted(set(col)):
            s = [slots_of(t) for t, x in zip(b.column(1).to_pylist(), col, strict=True) if x == lang and t]
            at, c = np.unique(np.concatenate(s) if s else np.empty(0, np.int64), return_counts=True)
            langs += [lang] * len(at)
            slots.append(at)
            n.append(c)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(slots) if slots else [], pa.int32()), pa.array(np.concatenate(n) if n else [], pa.int64())], names=["lang", "slot", "n"])

    got = arrow_map(rows, run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.full((len(langs), SLOTS), 0.1)
    for k, lang in enumerate(langs):
        g = got[got["lang"] == lang]
        counts[k, g["slot"].to_numpy()] += g["n"].to_numpy()
    return Model(langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def _sums(rows: DataFrame, key: str, langs: int, shared: Shared) -> DataFrame:
    out = rows.groupBy(key).agg(*(F.sum(f"q{k}").alias(f"{key}{k}") for k in range(langs)), F.count("*").alias(f"{key}_n"))
    return shared.write(out, f"by_{key}")


def identify(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", host: Column | None = None) -> DataFrame:
    """Returns id_col, lang, posterior, text_lang, declared, host for every row of pages.

    The posterior multiplies the text's likelihood (hashed byte trigrams), what the declared language and the
    address suffix say, each as P(language | it) / P(language), and the prior of the host. All these tables are grouped
    sums of the text's own posteriors over all pages, without the page itself. A host's prior is smoothed by its
    domain's, that by the mean of all pages, each worth PRIOR pages. The tables join by common.join_counted, so a
    language, suffix or host of many pages fills no task.

    Null and empty pages have no text, so the rest decides; a null URL has an empty host, whose pages share a prior.
    Ties go to the first language by name; without labelled texts lang is null. Repeated rows and ids, also null
    ids, give a row each; extra columns are left out.
    """
    shared, n = Shared(pages.sparkSession), len(model.langs)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = host if host is not None else F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1))
    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    kind = src.schema["id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pages_ = b.column(1).to_pylist()
        scores = np.zeros((b.num_rows, n))
        for k, p in enumerate(pages_):
            if t := visible_text(p).strip():
                scores[k] = model.logp[:, slots_of(t)].sum(1, dtype=np.float64) * TEMPER
        q = np.exp(scores - scores.max(1, keepdims=True, initial=-np.inf)) if n else scores
        q = q / q.sum(1, keepdims=True) if n else q
        cols = [pa.array(m[:, k], pa.float64()) for m in (scores, q) for k in range(n)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([declared_language(p) for p in pages_], pa.string()), *cols], names=["id", "host", "declared", *(f"{c}{k}" for c in "sq" for k in range(n))])

    if not n:
        none = F.lit(None)
        return src.select(F.col("id").alias(id_col), none.cast("string").alias("lang"), none.cast("double").alias("posterior"), none.cast("string").alias("text_lang"), F.lit("").alias("declared"), "host")
    numbers = ", ".join(f"{c}{k} double" for c in "sq" for k in range(n))
    rows = arrow_map(src, run, f"id {kind}, host string, declared string, {numbers}")
    labels = F.split("host", r"\.")
    rows = rows.withColumn("domain", F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")))
    rows = pages_read = shared.write(rows.withColumn("suffix", F.element_at(labels, -1)), "pages")
    total = rows.agg(*(F.coalesce(F.sum(f"q{k}"), F.lit(0.0)).alias(f"t{k}") for k in range(n)), F.count("*").alias("n")).first()
    mean = [(total[f"t{k}"] + 1 / n) / (total.n + 1) for k in range(n)]
    for key in ("declared", "suffix", "domain", "host"):
        rows = shared.write(join_counted(rows, _sums(pages_read, key, n, shared), [key], f"{key}_n", total.n), f"with_{key}")
    share = lambda key, k, prior: (F.col(f"{key}{k}") - F.col(f"q{k}") + PRIOR * prior) / (F.col(f"{key}_n") - 1 + PRIOR)
    logs = []
    for k in range(n):
        m = F.lit(mean[k])
        prior = share("host", k, share("domain", k, m))
        said = F.when(F.col("declared") != "", F.log(F.greatest(share("declared", k, m), F.lit(1e-9)) / m)).otherwise(0.0)
        suffix = F.when(F.col("suffix") != "", F.log(F.greatest(share("suffix", k, m), F.lit(1e-9)) / m)).otherwise(0.0)
        logs.append(F.col(f"s{k}") + said + suffix + F.log(F.greatest(prior, F.lit(1e-9))))
    names = F.array(*map(F.lit, model.langs))
    out = rows.withColumn("logs", F.array(*logs)).withColumn("best", F.array_max("logs")).withColumn("text", F.array(*(F.col(f"q{k}") for k in range(n))))
    pick = lambda a, m: F.get(names, F.array_position(a, m).cast("int") - 1)
    sure = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return out.select(F.col("id").alias(id_col), pick(F.col("logs"), F.col("best")).alias("lang"), sure.alias("posterior"), pick(F.col("text"), F.array_max("text")).alias("text_lang"), "declared", "host")
