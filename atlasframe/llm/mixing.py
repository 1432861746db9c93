"""Mixing sources to target weights: temperature, a bisected exponent and budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasframe.llm.common import documents, row_hash, written
from atlasframe.llm.token_counts import with_tokens

#: Documents of a block on average; a pass over a source is a permutation of its blocks, then of each block's rows.
BLOCK_DOCS = 2048
#: Rows (sources times passes) up to which the plan is sent to all tasks; a longer one is joined by key.
SENT_ROWS = 10_000
ADDED = ("mix_pass", "mix_tokens", "mix_position", "mix_weight")


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares to the power ``exponent``, normalised: 1 keeps them, 0 makes all sources equal."""
    raw = {k: v**exponent for k, v in shares.items()}
    total = math.fsum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def most_repeated(shares: dict[str, float], exponent: float) -> float:
    """How often the most repeated source is read while the least repeated one is read once."""
    ratio = [w / shares[k] for k, w in tempered(shares, exponent).items()]
    return max(ratio) / min(ratio)


def bisected_exponent(shares: dict[str, float], target_entropy: float | None = None, repetition_limit: float | None = None) -> float:
    """The exponent nearest to 1 that reaches ``target_entropy``, but not below the one at which a source is read ``repetition_limit`` times.

    Entropy falls and repetition falls as the exponent rises from 0 to 1, so each bound is found by bisection.
    Without ``target_entropy`` the repetition limit alone decides; without either the shares stay as they are.
    """
    if len(shares) < 2:
        return 1.0

    def least(ok) -> float:
        """The smallest exponent for which ``ok`` holds, which it does at 1."""
        if ok(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    bound = least(lambda a: most_repeated(shares, a) <= repetition_limit) if repetition_limit is not None else None
    if target_entropy is None:
        return 1.0 if bound is None else bound
    if entropy(tempered(shares, 1.0)) >= target_entropy:
        wanted = 1.0
    elif entropy(tempered(shares, 0.0)) < target_entropy:
        wanted = 0.0
    else:
        wanted = 1.0 - least(lambda b: entropy(tempered(shares, 1.0 - b)) >= target_entropy)
    return max(wanted, bound or 0.0)


def mix(docs: DataFrame, tokens: Column, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None, seed: int = 0) -> DataFrame:
    """Draw documents of ``docs`` (``doc_id``, ``source``, and any more columns, which are kept) so that sources get their target weights in tokens.

    Weights are the tempered token shares of the sources (null source: a source of its own). ``budget`` is the number of
    tokens to draw; without it, the least budget that reads every source whole at least once, so that no document is lost.
    A source is read in passes; each pass permutes blocks of its rows and the rows of each block; the last
    pass ends with the row that fills the source's budget. Repeated rows are rows of their own, told apart by nothing, so
    ties share a place by chance of their columns; no rows give no rows. Added columns, which replace any of their names: ``mix_pass`` (from 0), ``mix_tokens``,
    ``mix_position`` (0 to 1: order by it to interleave the sources evenly; parts of the result are ranges of blocks in that order, each sorted), ``mix_weight``.

    Only counts by source reach the driver. Sums run over blocks first, then within the one block of a source
    in which the budget ends, so that a source with most rows is no single task's work.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("_source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("_tokens"), row_hash(docs, kept).alias("_hash"), F.struct(*kept).alias("_row"))
    found = rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")).collect()
    if not found:
        return docs.select(*kept, F.lit(0).cast("long").alias("mix_pass"), F.lit(0).cast("long").alias("mix_tokens"), F.lit(0.0).alias("mix_position"), F.lit(0.0).alias("mix_weight")).limit(0)
    total = sum(r.tokens for r in found)
    shares = {r["_source"]: r.tokens / total for r in found if r.tokens}
    weights = tempered(shares, bisected_exponent(shares, target_entropy, repetition_limit))
    if budget is None:
        budget = math.ceil(max((r.tokens / weights[r["_source"]] for r in found if r.tokens), default=0))
    plan = [(r["_source"], float(weights[r["_source"]]), int(r.tokens), int(round(weights[r["_source"]] * budget)), math.ceil(r.docs / BLOCK_DOCS)) for r in found if r.tokens]
    passes = [(s, w, t, want, n, k, max(0, min(t, want - k * t))) for s, w, t, want, n in plan for k in range(max(1, math.ceil(want / t - 1e-9)))]
    passes += [(r["_source"], 0.0, 0, 1, math.ceil(r.docs / BLOCK_DOCS), 0, 1) for r in found if not r.tokens]  # nothing to weigh: each row once
    sources = docs.sparkSession.createDataFrame(passes, "_source string, mix_weight double, _all long, _want long, _n long, mix_pass long, _quota long").where("_quota > 0")

    drawn = rows.join(F.broadcast(sources) if len(passes) <= SENT_ROWS else sources, "_source")  # a row for each document and pass
    drawn = drawn.withColumn("_key", F.xxhash64(F.lit(seed), "mix_pass", "_id", "_hash")).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "mix_pass", "_id", "_hash"), F.col("_n")))
    blocks = drawn.groupBy("_source", "mix_pass", "_block").agg(F.sum("_tokens").alias("_sum"), F.first("_quota").alias("_quota"), F.first("_all").alias("_all"), F.first("_want").alias("_want"))
    order = Window.partitionBy("_source", "mix_pass").orderBy(F.xxhash64(F.lit(seed + 2), "mix_pass", "_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(order), F.lit(0))).where("_start < _quota or _quota >= _all")
    # Where a block begins in the mixture: rows are dealt by ranges of it, so that sources are interleaved as they are written, and each block is in one part.
    blocks = written(blocks.select("_source", "mix_pass", "_block", "_start", ((F.col("mix_pass") * F.col("_all") + F.col("_start")) / F.col("_want")).alias("_at")))
    own = ["_at", "_source", "mix_pass", "_block"]
    placed = drawn.drop("_n").join(blocks, ["_source", "mix_pass", "_block"]).repartitionByRange(*own)
    inside = Window.partitionBy(*own).orderBy("_key", "_id", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).where("_before < _quota or _quota >= _all")
    return placed.select(
        "_row.*", "mix_pass", F.col("_tokens").alias("mix_tokens"), ((F.col("mix_pass") * F.col("_all") + F.col("_before")) / F.col("_want")).alias("mix_position"), "mix_weight",
    ).sortWithinPartitions("mix_position")


def drawn_tokens() -> Column:
    """Counted tokens; an empty text takes one, so that it has a place in its source's budget and isn't lost."""
    return F.greatest(F.lit(1), F.col("n_tokens")).cast("long")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows are drawn, in which pass and place; the texts are read once, for their token counts."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    docs = written(with_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), drop=("text",)))
    return mix(docs, drawn_tokens(), repetition_limit=2.0).drop("n_tokens")
