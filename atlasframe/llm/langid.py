"""Language identification: an interpolated Kneser-Ney model of each language's n-grams, in tables that grow with the corpus.

The models never lie whole anywhere: training texts are counted by language, the weights of all n-grams are a table, each
slice of documents asks for its own n-grams once and puts the answers together to sorted arrays, one model for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasframe.llm.common import documents, release_memory, written
from atlasframe.llm.grams import SliceModel, chunked, compressed, count_grams, gram_weights, text_sums, texts_of, wanted_grams

ORDER = 4
#: How sharply the score falls with the difference of cross-entropies (nats a byte) from the best language.
SHARPNESS = 8.0
#: One in so many training texts is kept for the calibration of rejection.
HELD_BACK = 10
#: Bytes of text in a slice on average.
SLICE_BYTES = 64 << 20
SCORES = "lang_pred string, score double, cross_entropy double"


def folded(found: Iterator[bytes | None]) -> Iterator[bytes]:
    """Texts in lower case, as UTF-8; texts without a letter are empty, as they say nothing of a language."""
    for x in found:
        text = (x or b"").decode("utf-8", "replace")
        yield text.lower().encode("utf-8", "replace") if any(map(str.isalpha, text)) else b""


def plain(column: pa.Array) -> Iterator[bytes]:
    return folded(column.to_pylist())


def identify(docs: DataFrame, training: Column, sharpness: float = SHARPNESS, reject_above: float = 0.999, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Predict the language of every whole text of ``docs`` (``doc_id``, ``text``, ``lang``).

    ``training`` says which rows' text and lang may be learned from; a prediction sees the text alone. The
    language of least cross-entropy a byte wins, ties go to the first by name. ``lang_pred`` is ``und`` with
    score 0 if the text is null or has no letter, or if nothing could be learned. ``rejected`` marks texts that fit
    their language worse than ``reject_above`` of those training rows do whose counts the models leave out (one in HELD_BACK, by a hash of the text; of
    all, where a language has none of these). Texts without a language aren't learned from; very long ones are read whole. One row per input row, repeated rows and rows without id too; other
    columns are ignored; an empty table gives no rows. Returns ``doc_id``, ``held_out``, ``lang_pred``, ``score``,
    ``cross_entropy``, ``rejected``. Only the names of the languages and a limit for each reach the driver.
    """
    spark, raw = docs.sparkSession, F.col("text").cast("binary")
    learned = F.coalesce(training, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", learned.alias("_training"), (learned & (F.pmod(F.xxhash64(raw), F.lit(HELD_BACK)) == 0)).alias("_held_back"), raw.alias("_text"))
    known = rows.where("_training and not _held_back and lang is not null and _text is not null")
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    numbers = F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(langs)], "lang string, model int"))  # a row for each language
    weights = written(gram_weights(count_grams(known.join(numbers, "lang").select("model", "_text"), ORDER, plain), ORDER))

    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // slice_bytes))
    held = compressed(rows.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(parts)).cast("int")), "_text")

    def wanted(table: pa.Table) -> pa.Table:
        gram = wanted_grams(folded(texts_of(table.column("_text"))), ORDER)
        return pa.table({"_slice": pa.array(np.full(len(gram), table.column("_slice")[0].as_py(), np.int32)), "gram": pa.array(gram)})

    def named(table: pa.Table, answers: pa.Table) -> pa.Table:
        model, gram, alpha, gamma = (answers.column(c).to_numpy() for c in ("model", "gram", "alpha", "gamma"))
        models = [SliceModel(gram[own], alpha[own], gamma[own], ORDER) for k in range(len(langs)) for own in [np.flatnonzero(model == k)]]
        best, score, least = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for chunk in chunked(folded(texts_of(table.column("_text")))):
            logp, sizes = text_sums(chunk, models, ORDER)
            full = np.fromiter(map(bool, chunk), bool, len(chunk)) & bool(models)
            h = -logp / sizes[:, None] if models else np.zeros((len(chunk), 1))
            first = h.argmin(axis=1)
            low = h[np.arange(len(h)), first]
            best.append(np.where(full, first, -1))
            score.append(np.where(full, 1 / np.exp(-sharpness * (h - low[:, None])).sum(axis=1), 0.0))
            least.append(np.where(full, low, 0.0))
        names = [*langs, "und"]  # -1 is the last
        out = {"lang_pred": pa.array([names[k] for k in np.concatenate(best)], pa.string()), "score": pa.array(np.concatenate(score)), "cross_entropy": pa.array(np.concatenate(least))}
        release_memory()
        return pa.table({c: table.column(c) for c in kept} | out)

    kept = ["doc_id", "lang", "_training", "_held_back"]
    asked = held.groupBy("_slice").applyInArrow(wanted, "_slice int, gram long")
    answers = asked.join(weights, "gram").select("_slice", "model", "gram", "alpha", "gamma")
    schema = T.StructType([*(rows.schema[c] for c in kept), *T.StructType.fromDDL(SCORES)])
    scored = written(held.groupBy("_slice").cogroup(answers.groupBy("_slice")).applyInArrow(named, schema))
    # At most a row for each language that the models hold.
    limits = scored.where("_training and lang = lang_pred").groupBy(F.col("lang").alias("_of")).agg(
        F.coalesce(*[F.percentile_approx(x, reject_above, 10000) for x in (F.when(F.col("_held_back"), F.col("cross_entropy")), F.col("cross_entropy"))]).alias("_most")
    )
    return scored.join(F.broadcast(limits), scored.lang_pred == limits["_of"], "left").select(
        "doc_id", (~F.col("_training")).alias("held_out"), "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > F.col("_most"), F.lit(True)).alias("rejected")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32 of the id, modulo 4, is not 2; those rows are held out."""
    docs = documents(spark, sf_dir)
    return identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
