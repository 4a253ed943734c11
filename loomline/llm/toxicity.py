"""Toxicity: a chain of linear classifiers, each fed with the probabilities of the categories before it."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, arrow_map, for_a_task, hash_sample, shingle_set

#: Labelled rows that the chain is fitted on at most, in the order of a hash: of those with the last label, and of those without.
POSITIVE, NEGATIVE = 3_000, 6_000
#: Words and beginnings of words (by hash) that the classifiers look at, chosen by how they part the labels. A size of
#: the model, not of its input: all words of all labelled rows are counted before these are chosen.
FEATURES = 384
#: One is looked at if this share of a category's labelled rows holds it, at least five rows, and so many times the
#: share of the other rows; this keeps words of a few documents, of a topic or of a language out.
LEAST_SHARE, LEAST_LIFT = 0.005, 5.0
FOLDS, RIDGE, SEED = 5, 0.5, 1
_WORD = re.compile(rb"[a-z\x80-\xff]+|[!-/:-@\[-`{-~]{3,}")


@dataclass
class Chain:
    """Categories in order; the features that count (sorted); weights: one row for each category (features, earlier categories, constant)."""

    names: list[str]
    words: np.ndarray
    weights: list[np.ndarray]


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings of 3 to 8 bytes, so inflected forms share what stems tell."""
    forms = [word, *(word[:k] + b"*" for k in range(3, min(8, len(word)) + 1))]
    return tuple(xxhash.xxh3_64_intdigest(f) & 0x7FFFFFFF for f in forms)


class _Cache(dict):
    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, w: bytes) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        out = self[w] = self.fn(w)
        return out


_features = for_a_task(_Cache(features_of))


def words_in(text: str | None) -> set[bytes]:
    return set(_WORD.findall(text.encode("utf-8", "surrogatepass").lower())) if text else set()


def word_set(text: str | None) -> np.ndarray:
    """Sorted distinct features of a text's words: runs of a-z (A-Z lower-cased) and of what isn't ASCII; runs of three signs or more are words too."""
    return np.array(sorted({h for w in words_in(text) for h in _features[w]}), np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last is the constant, which isn't penalised."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + penalty * w
        h, v = np.zeros((len(w), len(w))), np.maximum(p * (1 - p), 1e-6)
        for at in range(0, len(x), 1000):  # in blocks, which spares copies of the whole matrix
            b = x[at : at + 1000].astype(np.float64)
            h += (b.T * v[at : at + 1000]) @ b
        h[np.diag_indices_from(h)] += penalty
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def fit_chain(x: np.ndarray, labels: np.ndarray, names: list[str], words: np.ndarray) -> Chain:
    """x: a row of 0 and 1 for each text, a column for each of words; labels: a column for each category. Later models
    learn from out-of-fold probabilities of the earlier ones."""
    n = len(x)
    fold = np.random.default_rng(SEED).permutation(n) % FOLDS
    weights, earlier = [], np.zeros((n, 0), np.float32)
    for k in range(labels.shape[1]):
        y, now = labels[:, k].astype(np.float64), np.column_stack([x, earlier])
        weights.append(fit_linear(now, y))
        out = np.zeros(n)
        for f in range(FOLDS):
            if (fold == f).any():
                out[fold == f] = _apply(now[fold == f], fit_linear(now[fold != f], y[fold != f]))
        earlier = np.column_stack([earlier, out.astype(np.float32)])
    return Chain(names, words, weights)


def telling(rows: DataFrame, categories: int, features: int) -> np.ndarray:
    """The features (sorted) that part a category's rows from the others best, from rows words array<int>, y array<int>.

    A feature's score is the greatest over the categories of (seen - expected) / sqrt(expected), where it has
    LEAST_SHARE and LEAST_LIFT; ties go to the least hash.
    """
    sums = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col("y")[k]), F.lit(0)).alias(f"t{k}") for k in range(categories))).first()
    each = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), *(F.sum(F.col("y")[k]).alias(f"p{k}") for k in range(categories)))
    score = F.lit(0.0)
    for k in range(categories):
        total, pos = sums[f"t{k}"], F.col(f"p{k}")
        expect = F.col("df") * (total / max(sums.n, 1))
        rest = (F.col("df") - pos + 0.5) / (sums.n - total + 1)
        ok = (pos >= max(5, LEAST_SHARE * total)) & (pos / max(total, 1) >= LEAST_LIFT * rest)
        score = F.greatest(score, F.when(ok, (pos - expect) / F.sqrt(F.greatest(expect, F.lit(1.0)))).otherwise(0.0))
    best = each.where("df >= 5").select("word", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "word").limit(features)
    return np.sort(np.array([r.word for r in best.collect()], np.int32))


def predict(chain: Chain, texts: list[str | None], cache: dict | None = None) -> np.ndarray:
    """One row of probabilities for each text; cache: word -> places of its features that count."""
    if cache is None:
        cache = _places(chain)
    x = np.zeros((len(texts), len(chain.words)))
    for r, t in enumerate(texts):
        for w in words_in(t):
            if places := cache[w]:
                x[r, list(places)] = 1
    earlier = np.zeros((len(texts), 0))
    for w in chain.weights:
        earlier = np.column_stack([earlier, _apply(np.column_stack([x, earlier]), w)])
    return earlier


def _places(chain: Chain) -> _Cache:
    at = {int(h): k for k, h in enumerate(chain.words)}
    return _Cache(lambda w: tuple(at[h] for h in features_of(w) if h in at))


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, Column]], id_col: str = "doc_id", text_col: str = "text", positive: int = POSITIVE, negative: int = NEGATIVE, features: int = FEATURES) -> Chain:
    """Fits the chain on the labelled rows of docs.

    categories: names and boolean columns over labels, in the chain's order; the last is what the sample is balanced
    by, null counts as false. The sample, at most `positive` and `negative` ids by a hash, is the one thing that is
    bounded; it is chosen among the labels alone, so docs are read once and not shuffled. All its words are counted
    as tables; the driver gets the `features` chosen and, for each row, which of them it has.

    A label without an id or a document, and a document without a label, don't take part. Of an id's labels each
    category's greatest counts, of its texts the least. Texts with equal sets of shingles and equal labels count once,
    null and empty ones being equal. Any other columns, whatever their names, are left out. Without labelled rows the
    chain has no features and gives each category the same low probability.
    """
    shared, names = Shared(docs.sparkSession), [n for n, _ in categories]
    y = F.array(*(F.coalesce(c, F.lit(False)).cast("int") for _, c in categories))
    known = labels.select(F.col(id_col).alias("k"), y.alias("y")).where("k is not null")
    known = known.groupBy("k").agg(F.array(*(F.max(F.col("y")[i]) for i in range(len(names)))).alias("y"))
    last = F.col("y")[len(names) - 1] == 1
    some = hash_sample(known.where(last), F.col("k"), positive).unionByName(hash_sample(known.where(~last), F.col("k"), negative))
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("k is not null").join(F.broadcast(some), "k")
    rows = rows.groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(0).to_pylist()
        sets, keys = [word_set(t) for t in texts], [xxhash.xxh3_128_digest(shingle_set(t).tobytes()) for t in texts]
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets) if sets else [], pa.int32())), b.column(1), pa.array(keys, pa.binary())], names=["words", "y", "key"])

    found = shared.write(arrow_map(rows, run, "words array<int>, y array<int>, key binary"), "labelled")
    words = telling(found.dropDuplicates(["key", "y"]), len(names), features)
    has = F.array_intersect("words", F.array(*map(F.lit, words.tolist())) if len(words) else F.array().cast("array<int>"))
    got = found.select(has.alias("has"), "y", "key").distinct().toArrow()
    shared.drop("labelled")
    by = sorted(zip(got.column("key").to_pylist(), got.column("y").to_pylist(), (sorted(h) for h in got.column("has").to_pylist()), strict=True))
    # Equal shingles may part words differently: one row of a key and its labels counts.
    by = [r for i, r in enumerate(by) if not i or r[:2] != by[i - 1][:2]]
    x = np.zeros((len(by), len(words)), np.float32)
    for i, (_, _, h) in enumerate(by):
        x[i, np.searchsorted(words, h)] = 1
    return fit_chain(x, np.array([r[1] for r in by], np.int64).reshape(-1, len(names)), names, words)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with tox_<category>, a probability for each category, for every row, in one narrow pass over whole texts.

    Null and empty texts have no words and get the constants' probabilities. Columns of the same name are replaced.
    """
    new = [f"tox_{n}" for n in chain.names]
    old = [c for c in docs.columns if c not in new]
    at = old.index(text_col)
    caches: list[_Cache] = []  # one in each worker

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not caches:
            caches.append(_places(chain))
        p = predict(chain, b.column(at).to_pylist(), caches[0])
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k], pa.float64()) for k in range(len(new)))], names=[*old, *new])

    src = docs.select(*old)
    return arrow_map(src, run, T.StructType([*src.schema.fields, *(T.StructField(n, T.DoubleType()) for n in new)]))


def label_categories(quality: str = "quality", toxic: str = "toxic") -> list[tuple[str, Column]]:
    """What the labels tell: low quality, toxic text of low quality, then toxic text."""
    low, bad = F.col(quality) == 0, F.col(toxic) == 1
    return [("low_quality", low), ("low_and_toxic", low & bad), ("toxic", bad)]
