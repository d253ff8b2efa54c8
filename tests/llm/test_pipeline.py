"""The pipeline's stages against brute force on a small corpus."""

import time
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import frame
from test_dedup import components, later_units
from test_texts import contamination, labelled
from test_tokens import ids_of

from kmerloom.llm import quality as Q
from kmerloom.llm._common import materialize, shared_dir


def shingles(text):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def similar(a, b):
    """Whether five-word shingle sets have a similarity of 0.8 or more."""
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows, labels = labelled(150)
    rows = [(i + 1000, t) for i, t in rows] + corpus
    own = [(i, t, None, f"src{i % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i + 1000, y, 0) for i, y in labels] + [(i, 1, 0) for i, _ in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    passage = dict(corpus)[125]
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, corpus, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], folder), name))
    texts = [[(r.doc_id, r.text) for r in f.collect()] for f in frames[:5]]
    assert all(f.columns == docs.columns for f in frames[:5])
    model = Q.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in Q.score_quality(docs, model).collect()}
    assert sorted(texts[1], key=repr) == sorted(((i, t) for i, t in texts[0] if scored[i]), key=repr) and len(texts[1]) < len(texts[0])
    lines = []
    for i, text, own, marks in later_units(texts[1], lambda t: [] if t is None else t.split("\n"), 3):
        if not any(marks) or not all(marks):
            lines.append((i, None if text is None else "\n".join(x for x, m in zip(own, marks, strict=True) if not m)))
    assert sorted(texts[2], key=repr) == sorted(lines, key=repr)
    sets = {i: shingles(t) for i, t in texts[2]}
    roots = components([(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])], set(sets))
    least = {}
    for i in sorted(sets):
        least.setdefault(roots[i], i)
    assert {i for i, _ in texts[3]} == set(least.values())
    bad = {r[0] for r in contamination([r for r in texts[3] if r[0] != 126], [(1, dict(corpus)[125])]) if r[-1]}
    assert {i for i, _ in texts[4]} == {i for i, _ in texts[3]} - bad and bad
    pieces = {}
    for r in frames[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.tokens)))
    assert set(pieces) == {i for i, _ in texts[4]}
    for i, t in texts[4]:
        assert np.frombuffer(b"".join(x for _, x in sorted(pieces[i])), "<u4").tolist() == [*ids_of(t), 1]
    assert corpus_pipeline.run(spark, folder).count() == frames[5].count()


def test_line_stage_keeps_the_callers_columns(spark):
    """Columns named like those of the operator come back as they were, and n_chars may be missing."""
    rows = [(1, "a\nb\nc\nd", 77, 88), (2, "a\nb\nc", 79, 90), (3, "a\nb\nc\ne", None, 91), (4, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, N_Removed long")
    assert sorted(map(tuple, corpus_pipeline.line_stage(spark, docs, "").collect())) == [rows[0], (3, "e", None, 91), rows[3]]
    counted = docs.withColumn("n_chars", docs.doc_id * 0)
    assert sorted((r.doc_id, r.n_chars) for r in corpus_pipeline.line_stage(spark, counted, "").collect()) == [(1, 0), (3, 1), (4, 0)]


def test_registered_queries_are_complete():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_frame_helper(spark):
    assert frame(spark, []).count() == 0


def test_run_leaves_what_its_last_stage_reads(spark, folder):
    """No stage's documents or tables stay once the next one's are written."""
    shared = Path(shared_dir(spark).removeprefix("file:"))
    tables = set(shared.iterdir())
    out = corpus_pipeline.run(spark, folder)
    assert {x.name.split("-")[0] for x in set(shared.iterdir()) - tables} == {"benchmark", "tokens"} and out.count()


def test_written_tables_leave_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in local for f in Path(str(d)).rglob("shuffle_*.data")}
    before = files()
    materialize(spark.range(1000).repartition(2, "id"), "dealt")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:  # Spark deletes them in the background
        time.sleep(0.2)
    assert not left
