"""A corpus pipeline of five stages; each works on what the one before has kept."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywork.llm import decontamination, ngram_jaccard, packing, suffix_dedup, toxicity
from quaywork.llm.common import scratch, table


#: Rows of a batch between Spark and Python, at most: a batch of whole texts is held by the executor and its worker at once.
BATCH = 2000


def small_batches(stage):
    """``stage`` with batches of ``BATCH`` rows, from then on in its session; a smaller number that is set there stays."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH:
            spark.conf.set(key, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


def _beside(docs: DataFrame, names: tuple[str, ...], stage) -> DataFrame:
    """What ``stage`` gives, where columns of ``docs`` that have names of its own results are out of its way."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in names}
    out = stage(docs.withColumnsRenamed(aside)).drop(*names)
    return out.withColumnsRenamed({v: c for c, v in aside.items()}).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not call toxic (a score below 0.5), those without an id or text among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _beside(docs, ("score",), lambda d: toxicity.score(d, model).where("score < 0.5"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id. Rows without an id stay."""
    found = ngram_jaccard.jaccard_components(docs)
    copies = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier, ``n_chars`` anew; a text of which nothing is left
    goes, one that was empty or null stays."""

    def stage(d: DataFrame) -> DataFrame:
        kept = suffix_dedup.remove_repeats(d, carry=[c for c in d.columns if c not in ("doc_id", "text")])
        left = kept.where("octet_length(text) > 0 or n_removed = 0")
        return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in d.columns else left

    return _beside(docs, ("n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"), stage)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, those without an id, text or words among them."""
    results = ("n_words", "n_hit", "items", "spans")
    return _beside(docs, results, lambda d: decontamination.contamination(d, table(spark, sf_dir, "benchmark")).where("n_hit = 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [(name, small_batches(stage)) for name, stage in (("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("benchmark", drop_benchmark), ("packing", pack))]

#: SQL cannot express the language models, the suffix arrays or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, f"pipeline-{uuid.uuid4().hex}/{k}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
