"""Near duplicates by shingle similarity, and the pipeline's stages from there on, against brute force."""

import random

import corpus_pipeline
import pytest
from conftest_llm import frame
from test_dedup import components
from test_pipeline import folder, shingles, similar  # noqa: F401

from kmerloom.llm import _tokens as T
from kmerloom.llm import near_duplicates as N
from kmerloom.llm import simhash as S


def survivors(rows):
    """The least id of each component of similar texts."""
    sets = {i: shingles(t) for i, t in rows}
    roots = components([(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])], set(sets))
    least = {}
    for i in sorted(sets):
        least.setdefault(roots[i], i)
    return set(least.values())


@pytest.fixture(scope="module")
def copies(corpus):
    """The corpus and copies of random texts with 1 to 30 % of their words changed, copies of copies among them."""
    rnd = random.Random(3)
    rows = list(corpus)
    for i in range(60):
        own = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(3, 300))]
        rows.append((1000 + 10 * i, " ".join(own)))
        for k in range(1, rnd.randint(2, 9)):
            own = list(own) if k % 2 else own
            for _ in range(rnd.randint(0, 1 + len(own) // 40)):
                own[rnd.randrange(len(own))] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(own).upper() if k == 3 else "\n".join(own)))
    return rows


@pytest.mark.parametrize("frequent", [0, 5, N.FREQUENT])
def test_components_are_those_of_similar_sets(spark, copies, monkeypatch, frequent):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    docs = frame(spark, copies)
    kept = S.drop_near_duplicates(docs, shingle=5, similar=(4, 5))
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(set(got)) and set(got) == survivors(copies)
    assert S.drop_near_duplicates(frame(spark, []), shingle=5, similar=(4, 5)).count() == 0


@pytest.mark.parametrize("sample", [1, 40])
def test_no_pair_depends_on_the_sample(spark, copies, monkeypatch, sample):
    """The sample orders shingles; all sets meet in that order, whatever it is."""
    monkeypatch.setattr(N, "SAMPLE", sample)
    kept = S.drop_near_duplicates(frame(spark, copies), shingle=5, similar=(4, 5)).collect()
    assert {r.doc_id for r in kept} == survivors(copies)


def test_stage_catches_one_changed_word(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for i in range(40):
        own = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([60, 100, 300]))]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:30], "changed", *own[31:]]))]
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {2 * i for i in range(40)}


def test_stage_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a b c d e f"), (None, "x y z u v w"), (1, "p q r s t u"), (1, "p q r s t u"), (1, "k l m n o p"), (2, "p q r s t u"), (3, "X Y Z u v w")]
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(None, "a b c d e f"), (1, "p q r s t u"), (1, "k l m n o p"), (3, "X Y Z u v w")], key=repr)


def test_benchmark_stage_with_null_and_repeated_ids(spark, tmp_path):
    passage = " ".join(f"b{i}" for i in range(40))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, passage), (None, "clean one"), (1, passage), (1, "clean two"), (1, "clean two"), (2, None), (None, None)]
    kept = corpus_pipeline.benchmark_stage(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(((i, t) for i, t in rows if t != passage), key=repr)


def resident_mb():
    with open("/proc/self/status") as lines:
        return int(next(x for x in lines if x.startswith("VmRSS")).split()[1]) / 1024


def test_tasks_give_back_what_earlier_ones_left(monkeypatch):
    class Table:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(N, "_dealt", lambda met: met)
    run = N.shared(Table())
    T.encoder(T.default_path())
    held = [bytearray(2000) for _ in range(50_000)]
    pin = bytearray(2000)  # free memory below it stays with the process
    del held
    before = resident_mb()
    assert list(run(iter([]))) == [] and len(pin) == 2000
    assert T.encoder.cache_info().currsize == 0
    assert resident_mb() < before - 80
