"""The pipeline on small tables, each stage against a plain version of what it says."""

import os
import random

import pytest

import corpus_pipeline as cp
from foliolake.llm import decontaminate, queries

from .test_operators import brute_groups, brute_lines

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_follow_one_another(spark, tmp_path):
    import sentencepiece as sp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality_classifier":
            scored = queries.op4_quality(spark, SF).where("predicted = 1").select("doc_id").collect()
            assert sorted(i for i, _ in after) == sorted(r[0] for r in scored)
        if name == "line_dedup":
            assert sorted(after) == sorted((i, t) for i, _, _, t in brute_lines(before))
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "ngram_jaccard_join":
            group, _ = brute_groups(before)
            assert sorted(i for i, _ in after) == sorted(max(i for i in group if group[i] == g) for g in set(group.values()))
        if name == "benchmark_decontamination":
            items = [decontaminate.word_ids(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            dirty = {i for i, t in before if any(decontaminate.distance(w, decontaminate.word_ids(t)) <= decontaminate.edits(len(w), 0.2) for w in items)}
            assert {i for i, _ in after} == {i for i, _ in before} - dirty
    lib = sp.SentencePieceProcessor(model_file=cp.token_counts.tokenizer_path("piece_bpe_32k.model"))
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in last} == {i: lib.encode(t) for i, t in after}
    whole = cp.run(spark, SF)
    assert {r["doc_id"]: r["ids"] for r in whole.collect()} == {r["doc_id"]: r["ids"] for r in last}


EXTRA = {"n": "1", "lost": "2", "__n": "3", "component_id": "4", "y": "5", "score": "6", "tags": "array('a')"}


def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"{v} as `{k}`" for k, v in EXTRA.items()))


def odd_rows():
    rng = random.Random(23)
    text = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    line = "one line that three near copies share with each other"
    near = text(60)
    rows = [(i, line + "\n" + near + f" {i}", "en", "s", 9) for i in (11, 12, 13)]
    rows += [(20, text(30), "en", "s", 9)] * 2 + [(20, text(25), "en", "s", 9), (None, text(30), None, None, None), (None, None, "en", "s", 0), (30, None, "en", "s", 0), (31, "", "en", "s", 0), (32, " \n\n", "en", "s", 3), (33, "long " * 60_000, "en", "s", 9)]
    return rows + [(40 + i, text(40), "en", "s", 9) for i in range(20)]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_every_stage_takes_odd_rows_and_none(spark, name, stage):
    docs = clashing(spark, odd_rows())
    out = stage(spark, docs, SF)
    last = name == "sentencepiece"
    assert last or out.columns == docs.columns
    assert stage(spark, docs.where("false"), SF).count() == 0
    got, had = out.collect(), docs.collect()
    if last or name == "line_dedup":
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in had)
    elif name == "ngram_jaccard_join":
        assert sorted(str(r["doc_id"]) for r in got) == sorted(["None", "None", *(str(i) for i in {r["doc_id"] for r in had} - {None, 11, 12})])
    elif name == "benchmark_decontamination":
        assert sorted(map(str, got)) == sorted(map(str, had))
    else:
        assert {str(r) for r in got} <= {str(r) for r in had}


def test_lines_that_repeat_in_near_copies_stay_somewhere(spark):
    docs = clashing(spark, odd_rows())
    for name, stage in cp.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert any("one line that three near copies share" in (t or "") for t in left.values())
    assert {"one line that three near copies share with each other", *(t.split("\n")[-1] for i, t, *_ in odd_rows() if i and i >= 40)} <= {x for t in left.values() for x in (t or "").split("\n")}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_returns_its_table(spark, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op1_") else ("pages", "page_id") if name.startswith("op5_") else ("conversations", "conv_id") if name.startswith("op7_") else ("documents", "doc_id")
    rows = queries.QUERIES[name](spark, SF).collect()
    ids = {r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    if name.startswith("op1_"):
        assert {r["query_id"] for r in rows} == {i for i in ids if i % 50 == 0}
    elif name.startswith("op10_"):
        assert {r["doc_id"] for r in rows} <= ids and rows
    else:
        assert {r[key] for r in rows} == ids | ({-7} if name.startswith("op7_") else set())


def test_stages_after_the_first_begin_with_the_heap_given_back(spark, monkeypatch):
    from foliolake.llm import common

    beans = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(spark._jvm.java.lang.Class.forName("java.lang.management.GarbageCollectorMXBean"))
    old = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = old()
    common.rested(spark)
    assert old() > before
    began = []
    monkeypatch.setattr(cp, "rested", lambda s: began.append(s))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF)
        assert len(began) == k
