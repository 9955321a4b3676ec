"""The pipeline against its stages done one by one in plain Python."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_pipeline(spark):
    from test_operators import split

    from ledgerframe.llm import pieces
    from ledgerframe.llm.decontaminate import benchmark_matches

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["toxicity"](spark, docs, DATA)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = {r.doc_id: r for r in kept.collect()}
    sets = {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := split(r.text)) else set() for i, r in rows.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    unique = steps["near_dedup"](spark, kept, DATA)
    assert {r.doc_id for r in unique.collect()} == {i for i in root if root[i] == i} and unique.columns == docs.columns
    cut = steps["repeats"](spark, unique, DATA)
    owners = {}
    for i in sorted(r.doc_id for r in unique.collect()):
        w = split(rows[i].text)
        for a in range(len(w) - 49):
            owners.setdefault(tuple(w[a : a + 50]), i)
    for r in cut.collect():
        w = split(rows[r.doc_id].text)
        gone = {j for a in range(len(w) - 49) if owners[tuple(w[a : a + 50])] != r.doc_id for j in range(a, a + 50)}
        assert split(r.text) == [x for j, x in enumerate(w) if j not in gone]
    clean = steps["decontamination"](spark, cut, DATA)
    leaks = {r.doc_id for r in benchmark_matches(cut, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - leaks and clean.columns == docs.columns
    model = pieces.Pieces(pieces.fixed_path(pieces.MODEL)).model
    expected = {r.doc_id: model.encode(r.text) + [model.eos_id()] for r in clean.collect()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DATA).collect()} == expected


def test_odd_rows_pass_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "x y", None, "s", 3), (3, "x y", None, "s", 3)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 1, 2, 3, 3]
    assert [r.n_tokens for r in got if r.doc_id == 1] == [1]


@needs_data
def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))


def test_extra_columns_and_repeated_ids_pass_every_stage(spark, tmp_path):
    """Columns that are called like those the stages use inside; ids that repeat with other texts; a very long text."""
    word = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    rows = [(1, word(60, "x")), (1, word(70, "y")), (2, f"{word(60, 'x')} {word(400, 'z')}"), (3, word(30_000, "long")), (4, f"lead {word(30, 'item')} tail"), (5, None), (None, "no id"), (6, word(70, "y"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), j, j, j, j, "k") for j, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, gone int, starts int, row_id int, known int, `a.b` string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, word(30, "item"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept.append({r.gone: r.text for r in now.collect()})
    assert kept[0].keys() == set(range(8))
    assert kept[1].keys() == {0, 1, 2, 3, 4, 5, 6}  # 6 is a copy of a text of 1
    assert kept[2][2] == word(400, "z") and {k: v for k, v in kept[2].items() if k != 2} == {j: t for j, (_, t) in enumerate(rows[:7]) if j != 2}
    assert kept[3].keys() == {0, 1, 2, 3, 5, 6}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 6
