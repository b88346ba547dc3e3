"""A corpus pipeline of five operators: language ID, exact dedup, near-dedup, PII masking and packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns that docs has, extra
ones included. Each stage handles empty tables, null columns and repeated rows as its operator documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import langid, pii
from graphmill.llm.common import BLANKS, Scratch, fresh, if_small, without
from graphmill.llm.exact_dedup import exact_dedup
from graphmill.llm.packing import pack
from graphmill.llm.queries import tokenizer
from graphmill.llm.simhash import simhash_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be determined: those with a letter. The network learns from the documents' own
    labels, the held-out fold excepted, and names the language of documents without a label in lang; if none is labelled,
    nothing can be told and nothing is rejected."""
    net = langid.fit(docs.where(~langid.held_out("doc_id", 5)))
    if net is None:
        return docs
    lang, score = fresh(docs, "lang_pred", "score")
    return langid.predict(docs, net, F.col("text"), [F.col(f"`{c}`") for c in docs.columns], lang, score).where(F.col(lang) != langid.UNDETERMINED).withColumn("lang", F.coalesce("lang", lang)).drop(lang, score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. Rows that repeat an id with another text are judged on their own; of
    rows with the same id and equal texts, the least in the order of all columns stays."""
    scratch = Scratch(spark, "pipeline-exact")
    found = scratch.write(exact_dedup(docs), "found")
    digest, known = fresh(docs, "digest", "known")
    key = F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANKS, ""), 256))

    def those(rows: DataFrame, listed: DataFrame, how: str, name: str) -> DataFrame:
        """Rows without, or with left_semi only with, the listed ids and digests; only rows with a listed id are hashed."""
        ids = scratch.write(listed.select(F.col("doc_id").alias(known)).distinct(), f"{name}-ids")
        n = ids.count()
        marked = rows.join(if_small(ids, n, 16), F.col("doc_id").eqNullSafe(F.col(known)), "left") if n else rows.withColumn(known, F.lit(None).cast("long"))
        same = F.col(known).isNotNull() | F.col("doc_id").isNull()
        return without(marked.withColumn(digest, F.when(same, key)).drop(known), [F.col("doc_id"), F.col(digest)], listed, how)

    gone = scratch.write(found.where(~F.col("kept")).select("doc_id", "digest").distinct(), "gone")
    left = those(docs, gone, "left_anti", "gone").drop(digest)
    again = found.where(F.col("kept") & (F.col("group_size") > 1)).groupBy("doc_id", "digest").count().where("count > 1")
    again = scratch.write(again.select("doc_id", "digest"), "again")
    if again.isEmpty():
        return left
    row = fresh(docs, digest, "row")[1]
    repeated = those(left, again, "left_semi", "again")
    one = repeated.groupBy("doc_id", digest).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return those(left, again, "left_anti", "rest").drop(digest).unionByName(one)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that pairs link whose SimHash fingerprints differ in at most two
    bits, found by a vantage-point tree, or whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Rows
    that share an id stay if one of them does."""
    scratch = Scratch(spark, "pipeline-near")
    found = scratch.write(simhash_dedup(docs, width=5, similarity=0.8), "found")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return without(docs, [F.col("doc_id")], scratch.write(gone, "gone"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars brought up to date."""
    out = docs.withColumn("text", pii.masked(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048, sources mixed in proportion. Workers that have run the stages before
    have less memory left for words than those of a lone packing job."""
    return pack(docs, tokenizer("word_bpe_49k.json"), words=32 << 20)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("pii", mask_private),
    ("packing", pack_sequences),
]

#: Byte networks, CRFs and BPE aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet and reread as the next one's docs,
    and goes when that one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
