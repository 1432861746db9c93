"""Merging many sources into one table, with every overruled value kept as a conflict row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence from strongest to weakest.
STATUSES = ("verified", "declared", "unresolved")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place of ``value`` in ``order`` (from 0); unknown values come last."""
    out = F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(order):
        out = out.when(value == v, F.lit(i))
    return out.otherwise(F.lit(len(order)))


def non_empty(c: Column) -> Column:
    """An empty string says "not known", as null does."""
    return F.nullif(c, F.lit("")) if not isinstance(c, str) else F.nullif(F.col(c), F.lit(""))


def claim(df: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by ``order`` owns it; returns (owners, the others as conflicts with ``won_by`` columns).

    ``order`` must tell rows apart, or the owner of a tie is not defined.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(w))
    first = numbered.where("_n = 1").drop("_n")
    won = first.select(*key, *[F.col(c).alias(f"won_by_{c}") for c in order])
    return first, numbered.where("_n > 1").drop("_n").join(won, key)


def first_non_empty(df: DataFrame, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """One row per key; each field takes its first non-empty value by ``order``. An aggregate, so it combines before the shuffle."""
    rank = F.struct(*order)
    picks = [F.min_by(F.col(f), F.when(non_empty(f).isNotNull(), rank)).alias(f) for f in fields]
    return df.groupBy(*key).agg(*picks)


def field_conflicts(df: DataFrame, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """A row (key, order columns, ``field``, ``kept``, ``lost``) for each non-empty value that differs from the kept one."""
    cells = df.select(*key, *order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), non_empty(F.col(f).cast("string")).alias("value")) for f in fields])).alias("_c"))
    cells = cells.select(*key, *order, "_c.field", "_c.value").where("value is not null")
    kept = cells.groupBy(*key, "field").agg(F.min_by("value", F.struct(*order)).alias("kept"))
    return cells.join(kept, [*key, "field"]).where("value <> kept").withColumnRenamed("value", "lost")


def union_lists(df: DataFrame, key: list[str], items: str, order: list[str]) -> DataFrame:
    """Items of all rows of a key once each, in the order in which they are first seen."""
    flat = df.select(*key, F.struct(*order).alias("_o"), F.posexplode(items).alias("_p", "_item"))
    firsts = flat.groupBy(*key, "_item").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return firsts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]).alias(items))


def raise_status(df: DataFrame, key: list[str], status: str, note: str, order: list[str], statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """The strongest status of each key and its first non-empty note."""
    return df.groupBy(*key).agg(
        F.min_by(status, F.struct(rank_of(F.col(status), statuses), *order)).alias(status),
        F.min_by(note, F.when(non_empty(note).isNotNull(), F.struct(*order))).alias(note),
    )


def lay_over(df: DataFrame, key: list[str], basis: str, fields: list[str], over: str, under: str, pinned: tuple[str, ...] = ()) -> DataFrame:
    """Rows of basis ``over`` win; fields in which a row of ``under`` differs and isn't empty become ``drift``.

    ``pinned``: lists of which ``under`` names some items; they drift if ``over`` has items, but not all of those.
    Each key has at most one row of either basis (others are conflicts; see ``claim``).
    """
    top = df.where(F.col(basis) == over).select(*key, *[F.col(f).alias(f"_a_{f}") for f in (*fields, *pinned)])
    low = df.where(F.col(basis) == under).select(*key, *[F.col(f).alias(f"_b_{f}") for f in (*fields, *pinned)])
    both = top.withColumn("_top", F.lit(True)).join(low.withColumn("_low", F.lit(True)), key, "full_outer")
    values = [F.when(F.col("_top"), F.col(f"_a_{f}")).otherwise(F.col(f"_b_{f}")).alias(f) for f in (*fields, *pinned)]
    drift = [F.when(F.col("_top") & F.col("_low") & non_empty(F.col(f"_b_{f}").cast("string")).isNotNull() & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]
    drift += [F.when(F.col("_top") & F.col("_low") & (F.size(f"_a_{f}") > 0) & (F.size(F.array_except(f"_b_{f}", f"_a_{f}")) > 0), F.lit(f)) for f in pinned]
    return both.select(*key, F.when(F.col("_top"), F.lit(over)).otherwise(F.lit(under)).alias(basis), *values, F.array_sort(F.array_compact(F.array(*drift))).alias("drift"))


#: Fields of a deployment in which the tree and the deployer may disagree.
DRIFTING = ["project", "cluster", "namespace", "path", "targetRevision"]


def fold_deployments(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row for each deployment ``id``, the rows that found their place taken).

    ``basis`` says who tells: the deployer (``api``, also where nothing is said), the tree (``manifest``), or both already. The first row of either basis counts; a folded row
    counts only as the first of its id, and then alone. Where both tell, the deployer's row stays, of basis ``both``, with the tree's service, tool and images where it
    has none, and ``drift`` holds what the tree says otherwise: its value of each field that it has and that differs, and its images that don't run while others do.
    """
    rows = df.withColumn("basis", F.coalesce("basis", F.lit("api")))
    place = Window.partitionBy("id").orderBy(*order)
    ranked = rows.withColumn("_first", F.first("basis").over(place)).withColumn("_nth", F.row_number().over(Window.partitionBy("id", "basis").orderBy(*order)))
    counts = (F.col("_nth") == 1) & ((F.col("basis") == F.col("_first")) | ((F.col("_first") != "both") & (F.col("basis") != "both")))
    held, lost = ranked.where(counts), ranked.where(~counts)
    tree = held.where("basis = 'manifest'").select("id", F.struct(*df.columns).alias("_t"))
    told = held.where("basis <> 'manifest'").select("id", "basis", F.struct(*df.columns).alias("_d"))
    both = told.join(tree, "id", "full_outer")
    met = F.col("_d").isNotNull() & F.col("_t").isNotNull()
    say = lambda f: F.when(F.coalesce(F.col(f"_t.{f}"), F.lit("")) != F.coalesce(F.col(f"_d.{f}"), F.lit("")), F.nullif(F.col(f"_t.{f}"), F.lit(""))).alias(f)
    missing = F.array_except(F.coalesce("_t.images", F.array().cast("array<string>")), F.coalesce("_d.images", F.array().cast("array<string>")))
    drift = F.struct(*map(say, DRIFTING), F.when((F.size("_d.images") > 0) & (F.size(missing) > 0), missing).alias("images"))
    some = F.greatest(*[drift[f].isNotNull().cast("int") for f in (*DRIFTING, "images")]) > 0
    values = {c: F.coalesce(f"_d.{c}", f"_t.{c}") for c in ("service",)} | {"tool": F.coalesce(F.nullif("_d.tool", F.lit("")), "_t.tool"), "images": F.when(F.size("_d.images") > 0, F.col("_d.images")).otherwise(F.col("_t.images"))}
    values |= {"basis": F.lit("both"), "drift": F.when(some, drift)}
    one = F.coalesce(F.col("_d"), F.col("_t"))
    pick = lambda c: F.col("id") if c == "id" else F.when(met, values[c]).otherwise(one[c]).alias(c) if c in values else F.when(F.col("_d").isNotNull(), F.col(f"_d.{c}")).otherwise(F.col(f"_t.{c}")).alias(c)
    return both.select(*map(pick, df.columns)).withColumn("basis", F.coalesce("basis", F.lit("api"))), lost.select(*df.columns)


def oldest(stamp: Column, value: Column) -> Column:
    """The value with the earliest readable time stamp, the least of equals; unreadable stamps have no vote."""
    at = F.try_to_timestamp(stamp)
    return F.min_by(value, F.when(at.isNotNull(), F.struct(at, value)))
