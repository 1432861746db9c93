"""A training-data pipeline over ``documents``: five operators of ``atlasframe.llm`` in a row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm import minhash, mixing, packing, quality, suffixes, token_counts
from atlasframe.llm.common import documents, ensure_checkpoint_dir, row_hash, written
from atlasframe.plans.checkpoints import delete_folder, scratch


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it learns from those labelled good.

    Null, empty and blank texts go; very long ones are judged whole; repeated rows and rows without id are judged like any other; a null language takes the
    limits of texts without one, or the widest. No labels: all texts that aren't blank stay. No rows, no rows; more columns stay as they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Only ids and hashes of rows go through the classifier with the texts; rows that are equal in all columns are judged alike.
    marks = F.coalesce(F.col("doc_id"), F.lit(0)).alias("_id"), row_hash(docs).alias("_mark")
    given = docs.select("doc_id", "text", "lang", *marks)
    fitted = quality.QualityClassifier.fit(given, quality.trusted_ids(labels), carry=["_id", "_mark"])
    kept = fitted.classify(given).where("quality_keep").select("_id", "_mark")
    own = F.struct(*docs.columns).alias("_row")
    return docs.select(own, *marks).join(written(kept), ["_id", "_mark"], "left_semi").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id, and all that are near no other.

    Null, empty and blank texts are near nothing and stay. Several rows of one id are one document: the row whose columns have the least hash stays, once. Rows without id stay, as no class
    can name them. Links at exactly the threshold count. No rows, no rows; more columns stay as they are.
    """
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), row_hash(docs).alias("_mark"))
    chosen = marked.where("_id is not null").groupBy("_id").agg(F.min("_mark").alias("_least")).join(kept, F.col("_id").cast("long") == F.col("_kept"), "left_semi")
    rows = marked.join(chosen.withColumnsRenamed({"_id": "_kept"}).hint("merge"), (F.col("_id") == F.col("_kept")) & (F.col("_mark") == F.col("_least")), "left_semi").dropDuplicates(["_id", "_mark"])
    return rows.select("_row.*").unionByName(docs.where("doc_id is null"))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that documents of smaller ids have; characters that a cut has halved go, and so do texts of which nothing is left.

    Null and empty texts have nothing left and go. Very long texts are read whole. Rows of one id are one document and don't cut one another. Rows without
    id stay as they are, but empty ones. No rows, no rows; more columns stay as they are; ``n_chars``, where there is one, is counted again.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).dropFields("text").alias("_row"))
    text = whole_characters(F.col("kept"))
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    out = suffixes.remove_repeats(rows, ["_row"]).where(F.length(text) > 0)
    out = out.select(*[own.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
    return out.unionByName(docs.where("doc_id is null and length(text) > 0"))


def whole_characters(data: Column) -> Column:
    """Bytes as text; where a cut has halved characters, what is left of them becomes replacement marks, which are taken out."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, rare sources up to twice, in tokens, in the order of the mixture, so that each file holds all sources.

    Null and empty texts take one token; very long ones count whole; a null source is a source of its own; repeated rows and rows without id are rows like any
    other. No rows, no rows; more columns stay as they are. The counted rows are kept in a folder, as they are read twice.
    """
    import public_tokenizers

    rest = [c for c in docs.columns if c != "text"]
    given = docs.select("doc_id", "source", F.struct(*rest).alias("_given"), F.col("text").alias("_text"), "text")
    counted = written(token_counts.with_tokens(given, public_tokenizers.path("byte_bpe_50k.json"), drop=("text",), remember=200_000))
    mixed = mixing.mix(counted, mixing.drawn_tokens(), repetition_limit=2.0)
    return mixed.select(*[F.col("_text").alias(c) if c == "text" else F.col("_given").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, see ``packing.pack``: a null text is its end mark alone, rows without id are packed too, repeated rows each."""
    import public_tokenizers

    # The workers have other stages' memory to share: fewer remembered words.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=60_000)


STAGES = [
    ("quality", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", remove_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No SQL: it can't express tokenizers, nor the trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared checkpoint folder and read from there by the next. Rows that no later stage needs are deleted."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
