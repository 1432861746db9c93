"""Stages of the pipeline on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _slice string, kept string, unit int, _text string, mix_position string, _mark string, _kept string, _id int, _given string, n_tokens string, mix_tokens string, bag map<string,int>"
WORDS = [f"word{k}" for k in range(400)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    text = lambda i: " ".join(WORDS[(i * 17 + 3 * k * k + k) % 400] for k in range(60)) + "."
    more = ("a", "b", 1, "c", "d", "e", "f", 2, "g", "h", "i", {"k": 1, "l": None})
    rows = [(i, text(i), ["en", "de", None][i % 3], ["x", "y", None][i % 3], 1, *more) for i in range(60)]
    rows += [(100, text(1), "en", "x", 1, *more), (101, None, "en", "x", None, *more), (102, "", None, None, 0, *[None] * 12), (103, " \n", "en", "x", 2, *more)]
    rows += [(None, text(70), "en", "x", 1, *more), (None, None, None, None, None, *[None] * 12), (104, "long " + text(71) * 2000, "en", "y", 1, *more)]
    rows += [(5, text(5), "en", "x", 1, *more)] * 2 + [rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(0, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return df, str(folder)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i or 0))


def more(df):
    """Values of the columns with clashing names, by id."""
    names = [f.name for f in df.schema.fields][5:]
    return {(r.doc_id, *(str(r[c]) for c in names)) for r in df.collect()}


def test_stages_on_odd_rows(spark, odd):
    df, folder = odd
    kept = corpus_pipeline.classify_quality(spark, df, folder)
    assert kept.columns == df.columns and not {101, 102, 103} & set(ids(kept)) and ids(kept).count(None) == 1 and len(ids(kept)) >= 60
    one = corpus_pipeline.drop_near_duplicates(spark, df, folder)
    assert one.columns == df.columns and ids(one) == [*range(60), 101, 102, 103, 104, None, None]
    cut = corpus_pipeline.remove_repeated_strings(spark, df, folder)
    assert cut.columns == df.columns and {r.n_chars == len(r.text) for r in cut.where("doc_id is not null").collect()} == {True}
    assert not {100, 101, 102} & set(ids(cut)) and ids(cut).count(5) == 3 and ids(cut).count(None) == 1
    mixed = corpus_pipeline.mix_sources(spark, df, folder)
    assert mixed.columns == df.columns and set(ids(mixed)) == set(ids(df)) and all(ids(mixed).count(i) >= ids(df).count(i) for i in set(ids(df)))
    for out in (kept, one, cut, mixed):
        assert more(out) <= more(df) and out.dtypes == df.dtypes
    assert more(mixed) == more(df)
    pieces = corpus_pipeline.pack(spark, df, folder)
    assert pieces.where("start = 0").count() == df.count()


def test_empty_tables(spark, odd, tmp_path):
    df, _ = odd
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert ids(corpus_pipeline.classify_quality(spark, df, str(tmp_path)).select("doc_id").distinct()) == [*range(60), 100, 104, None]


def test_run_leaves_no_stage_but_the_last(spark, odd):
    import glob

    df, folder = odd
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() >= 50
    home = spark.sparkContext.getCheckpointDir().replace("file:", "")
    (run,) = [x for x in glob.glob(f"{home}/corpus-*") if glob.glob(f"{x}/3/*")]
    assert glob.glob(f"{run}/*") == [f"{run}/3"] and not glob.glob(f"{home}/scratch-*")
