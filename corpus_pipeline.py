"""Language ID, n-gram Jaccard join, substring dedup and packing over ``documents``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.langid import identify
from tessera.llm.ngram_join import ngram_jaccard_components
from tessera.llm.packing import LENGTHS, pack
from tessera.llm.queries import language_model, n_words
from tessera.llm.scratch import Scratch
from tessera.llm.suffix_dedup import suffix_dedup


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the documents have a column of that name."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; those that stay keep all their columns.

    A null, empty or letterless text is rejected.  Null ids, repeated rows and columns of any name stay as they are.
    """
    names = unused(docs, "predicted", "likeness", "refused")
    return identify(docs, language_model(docs), names=tuple(names)).where(~F.col(names[2])).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, by five words and a similarity of 0.8.

    It is the row of the smallest doc_id; a row with a null doc_id only stays if its group has
    no other.  A null or blank text is a group of its own.  Different texts of one doc_id are documents of
    their own; a row that repeats both goes.  Rows are told apart by a 64-bit hash of id and text.
    """
    (key,) = unused(docs, "row_key")
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    groups = ngram_jaccard_components(docs.select(row.alias("doc_id"), "text"), n=5, percent=80, lower=True)
    groups = groups.select(F.col("doc_id").alias("row_key"), "component_id").join(docs.select(row.alias("row_key"), F.col("doc_id").alias("own_id")).distinct(), "row_key")
    first = F.min_by("row_key", F.struct(F.col("own_id").isNull(), "own_id", "row_key"))
    kept = groups.groupBy("component_id").agg(first.alias(key)).select(key)
    return docs.withColumn(key, row).join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 40 words or more that an earlier document has; an emptied document goes.

    Earlier is of a smaller doc_id: different texts of one doc_id are each cut for themselves, and
    a row with a null doc_id stays as it is, as do null texts.  A changed text has its words joined by one space, and
    its n_chars counted anew; other columns stay.
    """
    key, text = unused(docs, "text_key", "kept_text")
    cut = suffix_dedup(docs.select("doc_id", "text"), window=40, text_key=True)
    changed = cut.where("n_removed > 0").select("doc_id", F.col("text_key").alias(key), F.col("kept_text").alias(text)).dropDuplicates(["doc_id", key])
    out = docs.withColumn(key, F.xxhash64("text")).join(changed, ["doc_id", key], "left").where(F.col(text).isNull() | (F.col(text) != ""))
    out = out.withColumn("text", F.coalesce(text, "text"))
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, measured in words; a row for each piece (see ``pack``, also for nulls and repeated rows)."""
    return pack(docs, "doc_id", n_words(F.col("text")), permitted=LENGTHS)


STAGES = [("language_id", keep_known_languages), ("ngram_jaccard", keep_one_of_group), ("substring_dedup", cut_repeated_passages), ("best_fit_packing", pack_sequences)]

#: The stages cannot be written in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written before the next; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
