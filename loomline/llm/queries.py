"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, embeddings, langid, lm, minhash, mixing, secrets, sql, toxicity, urls
from .common import Shared, load


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file; every executor has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(load(spark, sf_dir, "documents"), tokenizer_path()))


def op2_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings, so every row of embeddings is rendered as one; ids divisible by 100 are looked up in all."""
    prints = audio.fingerprints(load(spark, sf_dir, "embeddings"), "embedding", "vec_id", audio.sung)
    prints = Shared(spark).write(prints, "prints")
    return audio.align(prints, prints.where("vec_id % 100 = 0"), "vec_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(load(spark, sf_dir, "documents"), tokenizer_path()))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


#: Weights of the tree's nodes: domain, language, source (null at an inner node). Others weigh 1.
MIX_WEIGHTS = [("d0", None, None, 5), ("d1", None, None, 3), ("d2", None, None, 2), *((d, x, None, w) for d in ("d0", "d1", "d2") for x, w in (("en", 6), ("de", 2)))]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.7, 2, "loom"


def mix_domain():
    """documents have no domain; one is dealt to each source."""
    return F.concat(F.lit("d"), (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 3).cast("string"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join("(" + ", ".join(map(text, w)) + ")" for w in MIX_WEIGHTS)
    weights = spark.sql(f"SELECT * FROM VALUES {rows} AS t(domain, language, source, w)")
    return mixing.mix(docs, weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED, domain=mix_domain())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed_documents(spark, load(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "domain", "language", "source", "tokens", "copies")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(load(spark, sf_dir, "embeddings"))


#: Probability of toxic from which a document is rejected.
REJECT = 0.5


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    return toxicity.train(docs, load(spark, sf_dir, "labels"), toxicity.label_categories())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))
    p = [c for c in out.columns if c.startswith("tox_")]
    return out.select("doc_id", *p, (F.col("tox_toxic") >= REJECT).alias("rejected"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "pages"), langid.learn(load(spark, sf_dir, "documents")))


#: The fixed rules. Fixed values.
URL_RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; tests/llm holds the others against brute force."""
    return {"op4_minhash_dedup": sql.OP4, "op5_mixing": sql.op5(MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED), "op6_embedding_dedup": sql.OP6}


_QUERIES = (op1_bpe, op2_audio_fingerprints, op3_secret_scan, op4_minhash_dedup, op5_mixing, op6_embedding_dedup, op7_toxicity, op8_lm_score, op9_language_id, op10_url_filter, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
