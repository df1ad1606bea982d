import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from guardframe.llm.secrets import masked, scan_text  # noqa: E402
from test_decontaminate import brute as overlaps  # noqa: E402
from test_neardup import brute as groups  # noqa: E402


def test_stage_rules(spark, awkward, sf_dir):
    docs = awkward.withColumn("n_chars", awkward.doc_id.cast("long"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    own = {tuple(r[c] for c in rest) for r in docs.select(rest).distinct().collect()}
    ids = lambda df: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.collect())
    kept = pipeline.language_id(spark, docs, sf_dir)
    assert ids(kept) == [-1, 3, 4, 5, 6, 7, 7, 8, 9]
    once = pipeline.near_dedup(spark, kept, sf_dir)
    assert ids(once) == [-1, 3, 4, 5, 6, 7, 9]
    clean = pipeline.decontamination(spark, once, sf_dir)
    assert ids(clean) == ids(once)
    scanned = pipeline.secret_scan(spark, clean, sf_dir)
    found = {r["doc_id"]: r for r in scanned.collect()}
    assert found[9]["text"] == "[SECRET] [SECRET]" and found[9]["n_chars"] == 17 and found[3]["text"] == "a"
    for stage in (kept, once, clean, scanned):  # the own columns, spans, hits, items, n_words, score, lang_pred and others
        assert stage.columns == docs.columns and {tuple(r[c] for c in rest) for r in stage.collect()} <= own
    assert ids(pipeline.bpe(spark, scanned, sf_dir)) == ids(scanned)


def test_rows_that_share_an_id_are_documents_of_their_own(spark, sf_dir):
    rows = [(5, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (5, "one two three four five six"), (7, "seven eight nine ten eleven twelve"), (None, "one two three four five six"), (None, None), (3, "")]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sf_dir)
    assert sorted(kept.collect(), key=str) == sorted([rows[0], rows[1], rows[5], rows[6]], key=str)


def test_empty_table(spark, nothing, sf_dir):
    docs = nothing
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name


def test_run_over_the_small_table_by_brute_force(spark, sf_dir):
    """All stages but the first's languages, in plain Python: only null texts and texts without letters have none."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    component = groups(docs, 5, 80)
    docs = [(i, t) for i, t in docs if component[i][1] == i]
    docs = [(i, t) for i, t in docs if not overlaps(t, items)[1]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = {}
    for i, t in docs:
        ids = tokenizer.encode(masked(t, scan_text(t), pipeline.MASK), add_special_tokens=False).ids
        expected[i] = len(ids), np.array(ids, dtype="<u4").tobytes()
    found = pipeline.run(spark, sf_dir).collect()
    assert len(found) == len(expected) and {r["doc_id"]: (r["n_tokens"], bytes(r["ids"])) for r in found} == expected
    assert len(pipeline.STAGES) == 5 and not re.search("SECRET", pipeline.ORACLE_SQL or "")


def test_stages_write_no_copy_of_the_texts(spark, sf_dir, tmp_path):
    import random
    from pathlib import Path

    from guardframe.llm.common import shared_dir

    rng, folder = random.Random(8), Path(shared_dir(spark).removeprefix("file://"))
    text = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(3000))
    rows = [(i // 2, text()) for i in range(40)] + [(None, None)]
    spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    size = lambda at: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    for stage, left in ((pipeline.near_dedup, rows), (pipeline.decontamination, rows + rows[:5])):
        before = size(folder)
        assert sorted(stage(spark, docs, sf_dir).collect(), key=str) == sorted(left, key=str)
        assert size(folder) - before < size(tmp_path) / 2


def test_numbers_are_of_one_row_each(spark, tmp_path):
    from guardframe.llm.common import numbered

    spark.range(500).withColumnRenamed("id", "doc_id").repartition(7).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for df, n in ((docs, 500), (docs.where("doc_id % 2 = 0"), 250), (docs.unionAll(docs), 1000), (docs.crossJoin(spark.range(3)), 1500), (spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs"), 1000), (docs.where("false"), 0), (spark.range(9), 9)):
        found = numbered(df, "__n")
        assert found.columns == [*df.columns, "__n"] and found.select("__n").distinct().count() == found.count() == n
        assert sorted(found.collect()) == sorted(found.repartition(3).collect())
    assert {r["__n"] for r in numbered(docs, "__n").collect()} == set(range(500))
