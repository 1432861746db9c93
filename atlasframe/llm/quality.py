"""Quality classifier: a modified Kneser-Ney model of trusted text gives each document a perplexity.

The n-grams are of raw bytes, so nothing is folded and their tables grow with the corpus. They stay on the executors:

1. trusted texts join the trusted ids, compressed; a bitmap of bounded size leaves most others where they are. Each task
   counts its own first, then the counts are summed by n-gram;
2. counts of lower orders, discounts and weights of contexts come from joins of the count tables by context;
3. texts are dealt to slices by one exchange, compressed; each slice asks for its different n-grams once, and these
   requests join the weights, sharded by n-gram;
4. the answers go back to their slice, which sums up the log-probability of each of its documents.

So the model is never whole anywhere.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasframe.llm.common import documents, release_memory, written
from atlasframe.llm.grams import SliceModel, chunked, compressed, count_grams, gram_weights, text_sums, texts_of, wanted_grams

ORDER = 5
#: Share of trusted documents of a language that the threshold of the language keeps.
KEEP_SHARE = 0.995
#: Bytes at its language's mean that are thought to be added to each document, as short texts vary more.
PRIOR_BYTES = 50
#: Text is repeated if it is so many times as far under its language's median as the lowest of the kept share.
FAR_UNDER = 2.0
#: A text is judged by counts of trusted texts of the other fold only; equal texts are in one fold.
FOLDS = 2
#: Bytes of text in a slice on average.
SLICE_BYTES = 64 << 20
#: Bits of the bitmap of trusted ids, 8 MB: it is sent to all tasks and spares texts a move, whatever it says.
BITS = 1 << 26


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("binary"))


def fold_of(key: Column) -> Column:
    return F.pmod(key, F.lit(FOLDS)).cast("int")


def dealt(docs: DataFrame, carry: list[str], parts: int) -> DataFrame:
    """Rows of ``docs`` in slices of one fold by a hash of id and text: ``_slice``, ``_row`` (the columns ``carry`` but ``text``), ``_text`` (compressed)."""
    raw = F.col("text").cast("binary")
    others = [c for c in carry if c != "text"]
    row = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(others)])
    return compressed(docs.select(slice_of(parts).alias("_slice"), row.alias("_row"), raw.alias("_text")), "_text")


def slice_of(parts: int) -> Column:
    return (F.pmod(F.xxhash64("doc_id", F.col("text").cast("binary")), F.lit(parts)) * FOLDS + fold_of(text_key())).cast("int")


def parts_for(docs: DataFrame, slice_bytes: int) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, math.ceil(size / (FOLDS * slice_bytes)))


def maybe_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose ``_id`` may be one of ``ids`` (``_id``): all that are, and few others while the ids are fewer than BITS."""
    at = F.pmod(F.xxhash64("_id"), F.lit(BITS))
    place = (F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit"))
    bitmap = ids.select(*place).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = rows.select("*", *place).join(F.broadcast(bitmap), "_bucket")  # BITS / 8 bytes at most
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0).select(*rows.columns)


def trusted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``_fold`` and ``_text`` (compressed) of the rows of ``docs`` whose id is in ``ids``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), fold_of(text_key()).alias("_fold"), F.col("text").cast("binary").alias("_text")).where("_id is not null")
    return compressed(maybe_among(rows, ids), "_text").join(ids.hint("merge"), "_id", "left_semi").select("_fold", "_text")


def trusted_weights(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Weights of n-grams of trusted texts, by the fold of the texts they are to judge (``model``), which is the other one."""
    counts = written(count_grams(trusted_texts(docs, ids), ORDER, texts_of))
    own = [r.model for r in counts.select("model").distinct().collect()]  # FOLDS rows at most
    of = F.lit(FOLDS - 1) - F.col("model") if len(own) == FOLDS else F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))  # all in one fold: nothing can be left out
    return gram_weights(counts.select(of.alias("model"), "code", "n"), ORDER)


def score(held: DataFrame, weights: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of every row of ``held`` (see ``dealt``), and its text's negative log-probability ``_nll`` and n-grams ``_n``.

    Texts that are null or blank have 0 n-grams. Nothing is joined by text, so repeated texts are no hot key; a slice asks for each n-gram once.
    """
    others = [c for c in carry if c != "text"]

    def wanted(table: pa.Table) -> pa.Table:
        number = table.column("_slice")[0].as_py()
        gram = wanted_grams(texts_of(table.column("_text")), ORDER)
        return pa.table({"_slice": pa.array(np.full(len(gram), number, np.int32)), "model": pa.array(np.full(len(gram), number % FOLDS, np.int32)), "gram": pa.array(gram)})

    def judged(table: pa.Table, answers: pa.Table) -> pa.Table:
        model = SliceModel(*(answers.column(c).to_numpy() for c in ("gram", "alpha", "gamma")), ORDER)
        nll, n, kept = [np.zeros(0)], [np.zeros(0, np.int64)], []
        for chunk in chunked(texts_of(table.column("_text"))):
            logp, sizes = text_sums(chunk, [model], ORDER)
            full = np.fromiter((bool(x.strip()) for x in chunk), bool, len(chunk))
            nll.append(np.where(full, -logp[:, 0], 0.0))
            n.append(np.where(full, sizes, 0))
            if "text" in carry:
                kept += chunk
        out = {"_row": table.column("_row")}
        if "text" in carry:
            valid = table.column("_text").is_valid().to_pylist()
            out["_text"] = pa.array([x if ok else None for x, ok in zip(kept, valid)], pa.binary())
        release_memory()
        return pa.table(out | {"_nll": pa.array(np.concatenate(nll)), "_n": pa.array(np.concatenate(n))})

    asked = held.groupBy("_slice").applyInArrow(wanted, "_slice int, model int, gram long")
    answers = asked.join(weights, ["model", "gram"]).select("_slice", "gram", "alpha", "gamma")
    text = [T.StructField("_text", T.BinaryType())] if "text" in carry else []
    schema = T.StructType([held.schema["_row"], *text, T.StructField("_nll", T.DoubleType()), T.StructField("_n", T.LongType())])
    out = held.groupBy("_slice").cogroup(answers.groupBy("_slice")).applyInArrow(judged, schema)
    place = {c: F.col(f"_row._{k}") for k, c in enumerate(others)} | {"text": F.col("_text").cast("string") if text else None}
    return out.select(*[place[c].alias(c) for c in carry], "_nll", "_n")


class QualityClassifier:
    """Weights of n-grams and, by language, the mean and the limits of cross-entropy (nats a byte)."""

    def __init__(self, weights: DataFrame, limits: dict[str | None, tuple[float, float, float]], overall: tuple[float, float, float], fitted: DataFrame, scores: DataFrame):
        self.weights, self.limits, self.overall = weights, limits, overall
        self.fitted, self.scores = fitted, scores

    @classmethod
    def fit(cls, docs: DataFrame, trusted: DataFrame, keep_share: float = KEEP_SHARE, carry: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> QualityClassifier:
        """Learn from the rows of ``docs`` (``doc_id``, ``text``, ``lang``) whose ``doc_id`` is in ``trusted``.

        Counts and quantiles are over all trusted rows and whole texts; each text is judged by the counts of the other fold, so
        that thresholds are of text the counts left out. Without trusted text, nothing is rejected but blank texts. Only
        limits by language reach the driver. ``carry``: the columns that ``classify`` is to return, all by default (``doc_id`` and ``lang`` are always among them).
        """
        carry = [c for c in docs.columns if c not in ADDED and (carry is None or c in (*carry, "doc_id", "lang"))]
        ids = trusted.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
        is_trusted = F.col("doc_id").cast("long") == F.col("_id")
        weights = trusted_weights(docs, ids)
        scores = written(score(dealt(docs, carry, parts_for(docs, slice_bytes)), weights, carry))
        scored = written(scores.where("_n > 0").select("doc_id", "lang", "_nll", "_n").join(ids, is_trusted, "left_semi"))
        mean = scored.groupBy("lang").agg((F.sum("_nll") / F.sum("_n")).alias("mean"))
        level = (F.col("_nll") + PRIOR_BYTES * F.col("mean")) / (F.col("_n") + PRIOR_BYTES)
        most = scored.join(mean.withColumnRenamed("lang", "_of"), F.col("lang").eqNullSafe(F.col("_of"))).groupBy("lang").agg(
            F.first("mean").alias("mean"), F.percentile_approx(level, [1 - keep_share, 0.5, keep_share], 10000).alias("at"), F.count("*").alias("n")
        ).collect()
        limits = {r.lang: (r["mean"], r["at"][2], r["at"][1] - FAR_UNDER * (r["at"][1] - r["at"][0])) for r in most}
        total = sum(r.n for r in most)
        overall = (sum(r["mean"] * r.n for r in most) / total, max(x[1] for x in limits.values()), min(x[2] for x in limits.values())) if total else (0.0, math.inf, -math.inf)
        return cls(weights, limits, overall, docs, scores)

    def classify(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` (the carried ones, if it is the table that ``fit`` saw, whose rows aren't scored again), and ``quality_cross_entropy``, ``quality_threshold``, ``quality_keep``.

        ``quality_keep``: the text isn't blank and its smoothed cross-entropy isn't over its language's threshold nor far under the usual
        range, as repeated text is; languages without trusted text take the overall mean and the widest limits. Null, empty and blank
        texts: cross-entropy null, not kept. Very long texts are read whole. One row per row, repeated rows and rows without id too; columns of those three names are
        replaced; an empty table gives no rows.
        """
        if docs is self.fitted:
            scores = self.scores
        else:
            carry = [c for c in docs.columns if c not in ADDED]
            scores = score(dealt(docs, carry, parts_for(docs, SLICE_BYTES)), self.weights, carry)
        limits = docs.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in self.limits.items()], "_of string, _mean double, _most double, _least double")
        mean, most, least = (F.coalesce(c, F.lit(float(o))) for c, o in zip(("_mean", "_most", "_least"), self.overall))
        level = F.when(F.col("_n") > 0, (F.col("_nll") + PRIOR_BYTES * mean) / (F.col("_n") + PRIOR_BYTES))
        # A row for each language of the trusted texts.
        joined = scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_of")), "left")
        columns = [c for c in scores.columns if c not in ("_nll", "_n")]
        return joined.select(*columns, level.alias("quality_cross_entropy"), most.alias("quality_threshold"), F.coalesce((level <= most) & (level >= least), F.lit(False)).alias("quality_keep"))


ADDED = ("quality_cross_entropy", "quality_threshold", "quality_keep")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents whose labels all say good quality (labels of one document may differ)."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", F.octet_length("text").cast("long").alias("n_bytes"))
    fitted = QualityClassifier.fit(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")), carry=["doc_id", "lang", "n_bytes"])
    out = fitted.classify(docs).select("doc_id", "lang", "n_bytes", "quality_cross_entropy", "quality_threshold", "quality_keep")
    return out.withColumn("perplexity", F.exp("quality_cross_entropy"))
