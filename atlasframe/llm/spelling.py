"""Spelling variants by a symmetric-delete join: words that share themselves or one of their single deletions meet and are verified."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm.common import CRC_SQL, CRC_TABLE_SQL, checkpoint, documents, written

#: Fixed value: what words consist of.
LETTERS = "[A-Za-zÀ-ÿ]"
KEYS = "key long, id long, size int, n long, word string"
#: Words up to this size travel with their keys; longer ones, whose keys are as many as their letters, are fetched for their candidates only.
CARRIED_SIZE = 64
#: Odd factor of the polynomial hashes (of 64 bits, so that it has an inverse).
FACTOR = 0x9E3779B97F4A7C15

#: Code points up to U+00FF as UTF-8; near words by places of deletions, and by deletions that are words.
ORACLE_SQL = f"""
with recursive {CRC_TABLE_SQL},
runs as (select doc_id, unnest(regexp_extract_all(text, '{LETTERS}{{7,}}')) as run from documents),
low as (select coalesce(doc_id::varchar, '') as id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as run from runs),
each as (select id, run, count(*) as c from low group by all),
coded as (select run, c, list_transform(string_split(id || ':' || run, ''), lambda x: ord(x)::bigint) as codes from each),
sums as (select run, c, {CRC_SQL.format(bytes="flatten(list_transform(codes, lambda o: case when o < 128 then [o] else [192 | (o >> 6), 128 | (o & 63)] end))")} as h from coded, crc),
cut as (select c, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from sums),
words as (select word, sum(c)::bigint as n from cut where length(word) >= 7 group by word having sum(c) >= 2),
gaps as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as gap from (select word, n, unnest(range(length(word))) as i from words)),
less as (select distinct g.word, g.n, w.word as other, w.n as other_n from gaps g join words w on g.gap = w.word),
near as (select word, other, other_n from less union all select other, word, n from less
    union all select a.word, b.word, b.n from gaps a join gaps b on a.gap = b.gap and a.i = b.i and a.word <> b.word),
best as (select word, count(*) as n_near, max(other_n) as top from near group by word),
told as (select w.word, w.n, coalesce(n_near, 0) as n_near,
    case when top >= 10 * w.n then top end as form_n, case when top >= 10 * w.n then (select min(other) from near x where x.word = w.word and x.other_n = top) end as form
    from words w left join best on w.word = best.word),
way as (select word, form as reached, 1 as steps from told where form is not null union all select way.word, told.form, steps + 1 from way join told on told.word = way.reached where told.form is not null),
ends as (select word, arg_max(reached, steps) as root from way group by word)
select told.word, form, coalesce(root, told.word) as root, n, n_near::bigint as n_near, form_n from told left join ends on ends.word = told.word
"""


def without(word: Column, at: Column) -> Column:
    """A word without its code point ``at`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), at.cast("int")), F.substr(word, at.cast("int") + 2))


def corpus_words(docs: DataFrame, least_letters: int = 7, least_count: int = 2, sown: int = 31) -> DataFrame:
    """Words of the texts of ``docs`` (``doc_id``, ``text``) and how often they occur (``word``, ``n``).

    A word is a maximal run of ``LETTERS``, A-Z in lower case. Where ``sown`` divides the checksum of ``<doc_id>:<word>``, one code point is taken out, the same
    in all places of the document. Null texts have no words; a null id is written as nothing; very long texts are read whole; repeated rows count each time.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(LETTERS + f"{{{least_letters},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), run.alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    sums = runs.select(low.alias("run"), "_id").select("run", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")).alias("h"))
    word = F.when(F.col("h") % sown == 0, without(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run"))
    found = sums.select(word.alias("word")).where(F.length("word") >= least_letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its distinct single deletions: (place of the word, hash).

    A prefix sum of code points times powers gives every deletion's hash at once: what lies behind the gap moves one power down. Two
    deletions of a word are the same just if only equal letters lie between them, so the last of each run of letters stands for all.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not sizes.sum():
        return np.arange(len(words)), np.zeros(len(words), np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(sizes.max()), FACTOR, np.uint64)), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum((codes + np.uint64(1)) * powers[np.arange(len(codes)) - starts[owner]], dtype=np.uint64))
    whole = sums[starts + sizes] - sums[starts]
    at = np.flatnonzero(np.append((codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1]), True))
    of = owner[at]
    gaps = sums[at] - sums[starts[of]] + (sums[(starts + sizes)[of]] - sums[at + 1]) * np.uint64(pow(FACTOR, -1, 1 << 64))
    return np.concatenate([np.arange(len(words)), of]), np.concatenate([whole, gaps]).view(np.int64)


def keyed(words: DataFrame) -> DataFrame:
    """Each word (``word``, ``n``) under its own hash and those of its single deletions, see ``KEYS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.searchsorted(sizes, np.arange(1 << 20, int(sizes[-1]) + (1 << 20) if len(sizes) else 0, 1 << 20)).tolist()
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, stop - start)
                if not part.num_rows:
                    continue
                place, keys = deletion_keys(part.column(3).to_pylist())
                places = pa.array(place)
                carried = pa.compute.if_else(pa.compute.less_equal(part.column(2), CARRIED_SIZE), part.column(3), pa.scalar(None, part.column(3).type))
                columns = [pa.array(keys), *(part.column(k).take(places) for k in (0, 2, 1)), carried.take(places)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "size", "n", "word"])

    return words.select(F.xxhash64("word").alias("id"), "n", F.length("word").alias("size"), "word").mapInArrow(run, KEYS)


def near_words(words: DataFrame) -> DataFrame:
    """Ordered pairs of words (``word``, ``n``; no word twice) at distance one: ``word``, ``other``, ``other_n``.

    Two words at distance one share exactly one hash, whatever they are: the shorter one itself, or the deletion of the letter that differs. So each ordered
    pair comes once. A hash is shared by no more words than there are places times letters; what shares one is verified by the edit distance, so hashes that
    collide find nothing wrong. Pairs are not kept: they go into the aggregation of the caller in the same stage.
    """
    keys = keyed(words)
    short = keys.where("word is not null")
    a, b = short.select("key", "word", "n"), short.select(F.col("key").alias("_key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    one = F.levenshtein("word", "other", 1) == 1
    found = a.join(b, (F.col("key") == F.col("_key")) & (F.col("word") != F.col("other")) & one).select("word", "other", "other_n")
    return found.unionByName(near_long_words(words, keys.where(F.col("size") >= CARRIED_SIZE)))


def near_long_words(words: DataFrame, keys: DataFrame) -> DataFrame:
    """The pairs of ``near_words`` with a word that doesn't travel with its keys: ids meet, then the words are fetched."""
    a, b = keys.select("key", "id", "size"), keys.select(F.col("key").alias("_key"), F.col("id").alias("_id"), F.col("size").alias("_size"))
    long = (F.greatest("size", "_size") > CARRIED_SIZE) & (F.abs(F.col("size") - F.col("_size")) <= 1)
    met = a.join(b, (F.col("key") == F.col("_key")) & (F.col("id") != F.col("_id")) & long).select("id", "_id").distinct()
    named = words.where(F.length("word") >= CARRIED_SIZE).select(F.xxhash64("word").alias("id"), "word")
    others = named.select(F.col("id").alias("_id"), F.col("word").alias("other")).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    return met.join(named, "id").join(others, "_id").where(F.levenshtein("word", "other", 1) == 1).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """The last form that each word (``word``, ``form``) reaches: ``word``, ``root``. Each round doubles the steps; a form is more frequent than its word, so there are no rings."""
    reached = written(forms.select("word", F.col("form").alias("root")))
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = checkpoint(reached.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        reached = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return reached


def group_spellings(words: DataFrame, times: int = 10) -> DataFrame:
    """The spellings of ``words`` (``word``, ``n``; no word twice): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Two words are near if one code point is inserted, deleted or replaced. The form of a word is its most frequent near word (ties: the
    first in code-point order) if it is at least ``times`` as frequent, else null; the root is the last form on the way, the word itself where there is none. ``times``
    is at least 2. An empty table gives no rows; very long words are compared whole.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("_best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("_best.less") >= times * F.col("n")
    told = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("_best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("_best.less")).alias("form_n"),
        )
    )
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(written(corpus_words(documents(spark, sf_dir))))
