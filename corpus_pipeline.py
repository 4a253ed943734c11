"""A training corpus from documents in five stages, each written and read again before the next.

Null and empty texts pass every stage. All columns of documents stay, whatever their names, until the last stage
replaces them. Every row is a document of its own until the second stage finds it a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, minhash, mixing, queries, secrets, toxicity
from loomline.llm.common import Shared, drop_since, load, tables_written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain, cols = queries.toxicity_chain(spark, docs, sf_dir), docs.columns
    own = [f"c{i}" for i in range(len(cols))]  # no column's name can be that of a score
    return toxicity.score(docs.toDF(*own), chain, f"c{cols.index('text')}").where(f"tox_toxic < {queries.REJECT}").select(*own).toDF(*cols)


#: Least Jaccard index, in percent, of two texts that are near copies. op4 alone has 85.
SIMILAR = 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of those with the least id (null comes last) the one with the least hash of all its columns.

    Rows, not ids, are grouped, so different texts under one id, and texts without an id, are judged alike. Null and
    empty texts are copies of nothing but of an equal row.
    """
    shared, cols = Shared(spark), docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    flat = shared.write(flat.select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64(F.to_json(F.struct("*"))).alias("h")), "rows")
    key, text = f"c{cols.index('doc_id')}", f"c{cols.index('text')}"
    found = shared.write(minhash.near_duplicates(flat, "row", text, percent=SIMILAR).select("row", "n_shingles", "component_id"), "found")
    named = flat.select("row", "h", key).join(found.hint("merge"), "row")
    # Without shingles only equal rows are copies.
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key), "h", "row")).alias("x")
    kept = shared.write(named.groupBy(group.alias("g"), F.when(F.col("n_shingles") == 0, F.col("h")).alias("e")).agg(first).select(F.col("x.row").alias("row")), "kept")
    return flat.join(kept.hint("merge"), "row", "left_semi").drop("row", "h").toDF(*cols)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced in its text."""
    return secrets.redact(docs, queries.tokenizer_path())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the budgets of its domain, language and source take it."""
    return mixing.taken(queries.mixed_documents(spark, docs))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's tokens."""
    return bpe.digests(bpe.encode(docs, queries.tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Trained classifiers and merges of subwords aren't expressible in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shared = load(spark, sf_dir, "documents"), Shared(spark)
    for k, (name, stage) in enumerate(STAGES):
        mark = tables_written()
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        docs = shared.write(out, name)
        drop_since(mark, shared.paths[name])
        if k:
            shared.drop(STAGES[k - 1][0])
    return docs
