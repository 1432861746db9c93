"""Prefix trie of conversations: polynomial prefix fingerprints by scans, verified groups, sums over subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasframe.llm.common import CRC_SQL, CRC_TABLE_SQL, release_memory, written

#: Odd base of the polynomial; sums are modulo 2**64.
BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
NOTHING = hashlib.sha256(b"").hexdigest()

#: Nodes as whole lists of turns; subtrees by the prefixes of each node's smallest conversation.
ORACLE_SQL = f"""
with {CRC_TABLE_SQL},
o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place from conversations where conv_id is not null),
c as (select conv_id, count(*) as n, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint) as codes from o group by conv_id),
k as (select conv_id, n, {CRC_SQL.format(bytes="codes")} % 6 as h from c, crc),
p as (select k.conv_id, k.n, k.h, k.conv_id - k.conv_id % 100 as leader, least(k.h, coalesce(l.n, 0)) as taken from k left join k l on l.conv_id = k.conv_id - k.conv_id % 100),
t as (select p.conv_id, o.place as depth, role, text from p join o on o.conv_id = p.leader and o.place <= p.taken
    union all select p.conv_id, o.place - p.h + p.taken, role, text from p join o on o.conv_id = p.conv_id and o.place > p.h),
m as (select conv_id, depth, list({{'role': role, 'text': text}}) over (partition by conv_id order by depth) as path from t
    union all select conv_id, 0, [] from p),
nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs from m group by path, depth),
held as (select m.conv_id as member, m.depth, nodes.conv_id from m join nodes on m.path = nodes.path and m.depth = nodes.depth),
up as (select nodes.*, held.conv_id as parent_conv_id from nodes left join held on held.member = nodes.conv_id and held.depth = nodes.depth - 1),
own as (select up.conv_id, up.depth, up.n_convs, up.parent_conv_id, count(kid.depth) as n_children,
    (up.n_convs - 1) * case when up.depth = 0 then 0 else length(any_value(up.path)[-1].text) end as saved
    from up left join up kid on kid.depth = up.depth + 1 and kid.parent_conv_id = up.conv_id group by up.conv_id, up.depth, up.n_convs, up.parent_conv_id),
below as (select held.conv_id, held.depth, count(*) filter (w.n_children = 0) as n_leaves, sum(w.saved) as saved_tokens
    from own w join held on held.member = w.conv_id and held.depth <= w.depth group by held.conv_id, held.depth),
ends as (select held.conv_id, held.depth, string_agg(held.member::varchar, ',' order by held.member) as ids
    from held join p on p.conv_id = held.member and held.depth = p.taken + greatest(p.n - p.h, 0) group by held.conv_id, held.depth)
select own.conv_id, own.depth, own.parent_conv_id, own.n_convs, own.n_children, below.n_leaves, below.saved_tokens::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from own join below on below.conv_id = own.conv_id and below.depth = own.depth left join ends on ends.conv_id = own.conv_id and ends.depth = own.depth
"""


def wrapping_sum(a: Column, b: Column) -> Column:
    """The sum of two longs modulo 2**64 (plain sums raise an error beyond the range)."""
    low_bits = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(low_bits) + b.bitwiseAND(low_bits)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low_bits))


def powers(exponents: np.ndarray) -> np.ndarray:
    """``BASE`` to each exponent, modulo 2**64, by repeated squaring."""
    out, base, left = np.ones(len(exponents), np.uint64), BASE, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(base), out)
        base, left = base * base & MASK, left >> np.uint64(1)
    return out


def running_sums(df: DataFrame, order: list[str], term: str, power: str | None) -> DataFrame:
    """All columns of ``df`` and ``before``, ``through``: the sum modulo 2**64 of ``term`` (times ``BASE`` to the power ``power``) over the rows of the same ``order[0]``, in the order of ``order``.

    Rows are dealt by ranges of ``order``, so that a key with very many rows is spread over tasks. Each task scans its rows with numpy; one row a task, with
    the last sum of its last key, tells the next ones where to start. Keys are longs without nulls; the result is written and read again.
    """
    key = order[0]
    names = df.columns
    local = [T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("_through", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, total = TaskContext.get().partitionId(), None, np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            terms = batch.column(batch.schema.get_field_index(term)).to_numpy().view(np.uint64)
            if power:
                terms = terms * powers(batch.column(batch.schema.get_field_index(power)).to_numpy())
            sums = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
            starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            base = np.repeat(sums[starts], np.diff(np.append(starts, len(keys))))
            if keys[0] == held:
                first = len(keys) if len(starts) == 1 else starts[1]
                base[:first] -= total
            before, through = sums[:-1] - base, sums[1:] - base
            held, total = keys[-1], through[-1]
            columns = [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(before.view(np.int64)), pa.array(through.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_before", "_through"])
        release_memory()

    schema = T.StructType([*df.schema.fields, *local])
    scanned = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    last = F.max(F.struct(key, *order[1:], "_through"))
    parts = scanned.groupBy("_part").agg(F.min(key).alias("_first"), last.alias("_last")).select("_part", "_first", F.col("_last")[key].alias("_key"), F.col("_last._through").alias("_sum"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, 0
        for batch in batches:
            found = []
            for part, first, last, own in zip(*(c.to_pylist() for c in batch.columns)):
                if first == held:
                    found.append((part, first, total))
                total = (total if first == held == last else 0) + own
                held = last
            parts, keys, sums = zip(*found) if found else ((), (), ())
            signed = np.array([s & MASK for s in sums], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.int64()), pa.array(signed)], names=["_part", key, "_start"])

    starts = parts.repartition(1).sortWithinPartitions("_part").mapInArrow(carry, f"_part int, `{key}` long, _start long")
    start = F.coalesce("_start", F.lit(0))
    # One row a task at most, so its size is bound by the number of tasks.
    return scanned.join(F.broadcast(starts), ["_part", key], "left").select(
        *names, wrapping_sum(F.col("_before"), start).alias("before"), wrapping_sum(F.col("_through"), start).alias("through")
    )


def rebuild(conversations: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``, ``turn``, ``role``, ``text``) that begin with the turns of the first one of their block.

    Conversation c gets the first h turns of conversation ``c - c % block``, then its own turns after its first h; h is the checksum of c modulo ``most``. Turns
    are ordered by ``turn`` (null first), then role and text; a null role or text is empty. Rows without ``conv_id`` belong to no conversation. Returns the
    turns (``conv_id``, ``depth`` from 1, ``role``, ``text``) and the conversations (``conv_id``, ``size``: their turns, 0 where none is left).
    """
    given = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")], F.lit(1).cast("long").alias("one")
    )
    turns = running_sums(given, ["conv_id", "turn", "role", "text"], "one", None).select("conv_id", "role", "text", F.col("through").alias("place"))
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    known = written(own)
    leaders = known.select(F.col("conv_id").alias("leader"), F.col("n_own").alias("n_leader"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most).cast("long"))
    plan = known.select("conv_id", "n_own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("leader")).join(leaders, "leader", "left")
    plan = written(plan.withColumn("taken", F.least("h", F.coalesce("n_leader", F.lit(0)))))
    taken = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "leader").join(plan.where("taken > 0").select("conv_id", "leader", "taken"), "leader").where("place <= taken")
    kept = turns.join(plan.where("n_own > h").select("conv_id", "h", "taken"), "conv_id").where("place > h")
    rows = taken.select("conv_id", F.col("place").alias("depth"), "role", "text").unionByName(kept.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "role", "text"))
    return rows, plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("size"))


def turn_mark(seed: int) -> Column:
    """64-bit hash of a turn."""
    return F.xxhash64("role", "text", F.lit(seed))


def prefix_groups(turns: DataFrame, mark=turn_mark) -> tuple[DataFrame, DataFrame]:
    """Turns with ``print``, the fingerprint of the prefix that ends with them, and ``above``, that of the prefix before; and the groups of equal prefixes.

    Prefixes of one depth and fingerprint are one group, whose representative is its smallest conversation. A group is verified turn by turn: all its
    last turns equal the representative's just if the least and the greatest of them are equal, and where all groups pass, equal fingerprints and equal last turns
    leave equal fingerprints one turn up, and so on to the first turn. The turns of a group that fails and that differ from its least one are hashed anew, which
    splits the group and all below, until none fails. Returns also one row for each group: ``depth``, ``print``, ``above``, ``conv_id`` (the smallest), ``n_convs``, ``n_chars``.
    """
    seed = 0
    turns = turns.withColumn("mark", mark(seed))
    while True:
        scanned = running_sums(turns, ["conv_id", "depth"], "mark", "depth").withColumnsRenamed({"before": "above", "through": "print"})
        turn = F.struct("role", "text")
        groups = written(
            scanned.groupBy("depth", "print").agg(
                F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("above").alias("above"), F.min(turn).alias("least"), F.max(turn).alias("greatest")
            ).withColumns({"n_chars": F.length("least.text").cast("long"), "fails": F.col("least") != F.col("greatest"), "least": F.when(F.col("least") != F.col("greatest"), F.col("least"))}).drop("greatest")
        )
        failed = groups.where("fails")
        if failed.isEmpty():
            return scanned.select("conv_id", "depth", "print", "above"), groups.drop("fails", "least")
        seed += 1
        wrong = scanned.join(failed.select("depth", "print", "least"), ["depth", "print"]).where(turn != F.col("least"))
        anew = wrong.select("conv_id", "depth", turn_mark(seed).alias("_new"))
        turns = written(scanned.drop("above", "print").join(anew, ["conv_id", "depth"], "left").withColumn("mark", F.coalesce("_new", "mark")).drop("_new"))


def member_hashes(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids (``conv_id``) of each (``depth``, ``print``).

    Ids are dealt by ranges and joined to strings where they lie, so a group with very many ids is spread over tasks; only these strings, a few for each task, then
    pass through the hash one after the other.
    """
    order = ["depth", "print", "conv_id"]

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
        depth, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.append(0, np.flatnonzero((depth[1:] != depth[:-1]) | (mark[1:] != mark[:-1])) + 1).tolist()
        for start, stop in zip(starts, [*starts[1:], len(depth)]):
            yield int(depth[start]), int(mark[start]), start, stop

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(2).to_pylist()
                found = [(d, m, ids[a], ",".join(map(str, ids[a:b]))) for d, m, a, b in groups(batch)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["depth", "print", "conv_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            found = []
            for depth, mark, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (depth, mark) == held:
                    state.update(b",")
                else:
                    if held is not None:
                        found.append((*held, state.hexdigest()))
                    held, state = (depth, mark), hashlib.sha256()
                state.update(ids.encode())
            if found:
                yield rows(found)
        if held is not None:
            yield rows([(*held, state.hexdigest())])

    def rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["depth", "print", "ends_sha256"])

    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join_ids, "depth long, print long, conv_id long, ids string")
    return pieces.repartition("depth", "print").sortWithinPartitions(*order).mapInArrow(digest, "depth long, print long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, prints: DataFrame, names: list[str], height: int) -> DataFrame:
    """``names`` of ``nodes`` summed over subtrees, whose height is at most ``height``: in round k each node adds the sums of the nodes 2**k below it.

    The ancestor of a node is a prefix of its smallest conversation, so ``prints`` (``conv_id``, ``depth``, ``print``) names it by a key that no two rows share.
    """
    step = 1
    while step <= height:
        lower = nodes.where(F.col("depth") >= step).select("conv_id", (F.col("depth") - step).alias("depth"), *names)
        found = lower.join(prints, ["conv_id", "depth"]).groupBy("depth", "print").agg(*[F.sum(c).alias(f"_{c}") for c in names])
        nodes = written(nodes.join(found, ["depth", "print"], "left").select(*[c for c in nodes.columns if c not in names], *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names]))
        step *= 2
    return nodes


def prefix_trie(turns: DataFrame, sizes: DataFrame, mark=turn_mark) -> DataFrame:
    """The nodes of the trie of all prefixes of conversations.

    ``turns``: ``conv_id``, ``depth`` (1, 2, ... in each conversation), ``role``, ``text`` (no nulls); ``sizes``: ``conv_id`` (no id twice), ``size``, for conversations without turns too.
    Returns, for each distinct sequence of first turns (the root: none), ``conv_id`` (smallest conversation that begins so), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes below or at it), ``saved_tokens`` (code points of the last texts that all but one of a node's
    conversations repeat, below or at it), ``ends_sha256`` (see ``member_hashes``, over the conversations that end there). No conversations, no rows. Equal
    conversations are members of the same nodes; any depth takes as many rounds as its logarithm.
    """
    prints, groups = prefix_groups(turns, mark)
    prints = written(prints)
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = root.select(zero.alias("depth"), zero.alias("print"), none.alias("above"), "conv_id", "n_convs", zero.alias("n_chars"))
    nodes = groups.select("depth", "print", "above", "conv_id", "n_convs", "n_chars").unionByName(top)
    children = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("print")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    n_children = F.coalesce("n_children", zero)
    full = written(
        nodes.join(children, ["depth", "print"], "left").join(parents, ["depth", "above"], "left")
        .select("depth", "print", "conv_id", "parent_conv_id", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    )
    height = full.agg(F.max("depth")).first()[0] or 0
    every = prints.select("conv_id", "depth", "print").unionByName(sizes.select("conv_id", zero.alias("depth"), zero.alias("print")))
    summed = subtree_sums(full, every, ["n_leaves", "saved_tokens"], height)
    ends = every.join(sizes.select("conv_id", F.col("size").alias("depth")), ["conv_id", "depth"])
    return summed.join(member_hashes(ends), ["depth", "print"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sizes = rebuild(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(turns, written(sizes))
