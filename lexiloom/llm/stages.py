"""Pipeline stages over ``documents``: each returns the rows it keeps, in the columns it got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, minhash, mixing, token_files
from lexiloom.llm import toxicity as toxic
from lexiloom.llm.common import BROADCAST_ROWS, keep_ids, read_table, row_key
from lexiloom.llm.queries import word_tokenizer
from lexiloom.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from ``labels`` rejects go."""
    source = read_table(spark, sf_dir, "documents")
    lexicon = toxic.fit_lexicon(source, read_table(spark, sf_dir, "labels"))
    return docs.where(toxic.toxicity_score(lexicon, spark, F.col("text")) < toxic.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: five-word shingles, similarity 0.8.

    Of rows that repeat an id one stays, the one with the smallest text; rows without an id all stay.
    """
    kept = minhash.near_duplicates(docs, width=5, percent=80).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(kept, "kept")
    once = kept.where("n = 1 OR doc_id IS NULL").select("doc_id")
    again = kept.where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    out = _rows_with(docs, once)
    if again.isEmpty():
        return out
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _rows_with(docs, again).groupBy("doc_id").agg(F.min_by(whole, F.struct(F.col("text").isNull(), "text")).alias("__row"))
    return out.unionByName(rows.select("__row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words running of a benchmark item go."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), slop=0)
    bad = cut_lineage(found.where("contaminated").select(F.col("key").alias("__found")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, row_key("doc_id", "text") == bad["__found"], "left_anti")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities of their source, language and topic stay."""
    kept = cut_lineage(mixing.mix_documents(docs).where("drawn").select("doc_id").distinct(), "kept")
    return _rows_with(docs, kept)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: a row per document."""
    return token_files.token_files(docs, word_tokenizer())


def _rows_with(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among the distinct ids, null being a value like any other."""
    out = keep_ids(docs, "doc_id", ids.where("doc_id IS NOT NULL"))
    return out if ids.where("doc_id IS NULL").isEmpty() else out.unionByName(docs.where("doc_id IS NULL"))
