"""The corpus pipeline on a small table, stage by stage."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_work_on_what_is_kept(spark, tmp_path):
    r = random.Random(8)
    en, de = ("the of and to in that it was for on with his they be at one have this from".split(), "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als".split())
    text = lambda words, n: " ".join(r.choice(words) + r.choice(("", "s", "er", "ing")) for _ in range(n)) + "."
    rows = [(i, text(en if i % 3 else de, 120), "en" if i % 3 else "de", "s", 1) for i in range(60)]
    rows += [(100, rows[5][1], "en", "s", 1), (101, rows[5][1] + " more", "en", "s", 1), (102, "123 456 !", "en", "s", 1), (103, None, None, None, None), (104, "too short", "en", "s", 1), (105, "spam now " * 80, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicate_join", "best_fit_packing"]
    kept, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
        kept[name] = {x["doc_id"] for x in frame.collect()}
    clean = set(range(60))
    assert clean <= kept["language_id"] and not {102, 103} & kept["language_id"]
    assert kept["quality_rules"] == kept["language_id"] - {104, 105}
    assert kept["near_duplicate_join"] == kept["quality_rules"] - {100, 101}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == kept["near_duplicate_join"]


def test_empty_tables_and_columns_of_any_name(spark, tmp_path):
    clashing = ["row", "node", "rank", "keys", "family", "w", "t", "lang_pred", "score", "kept", "failures", "sequence_id", "offset", "length", "piece", "n", "least", "label", "signature"]
    base = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(3)
    words = "the of and to in that it was for on with his they be at one have this from".split()
    text = lambda: " ".join(r.choice(words) + r.choice(("", "s", "ed", "ing")) for _ in range(90))
    rows = [(i, text(), "en", "s", 1) for i in range(20)] + [(None, text(), None, None, None), (None, None, "en", None, None)]
    rows += [rows[3], rows[3]]
    for name, some in (("full", rows), ("none", [])):
        docs = spark.createDataFrame(some, base).selectExpr("*", *(f"'x' AS `{c}`" for c in clashing))
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted(str(x["doc_id"]) for x in out) == (sorted(map(str, [*range(20), None])) if some else [])
