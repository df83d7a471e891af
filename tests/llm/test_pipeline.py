"""The pipeline on small and awkward corpora, stage by stage against brute force."""

import os
import random
import sys
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import brute  # noqa: E402
from test_llm import PATH, SCHEMA, awkward, near_components  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

MARKS = {i * 3: int(i % 4 != 1) for i in range(60)}


@pytest.fixture()
def corpus(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(i, q, 0) for i, q in MARKS.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def test_stages(spark, corpus, tmp_path):
    """Each stage on what the one before it kept, row by row."""
    d = corpus(awkward())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    tokens = lambda t: tok.encode(t, add_special_tokens=False).ids
    rows = [(r[0], r[3], r[1] or "") for r in awkward()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == before.columns
            got = Counter((r.doc_id, r.source, r.text or "") for r in docs.select("doc_id", "source", "text").collect())
        if name == "quality":
            kept = Counter((i, t) for i, t, *_, kept in brute.quality([(i, t) for i, _, t in rows], MARKS) if kept)
            assert Counter((i, t) for i, _, t in got.elements()) == kept and len(rows) > kept.total() > 20
        elif name == "exact_dedup":
            best = {}
            for i, _, t in rows:
                best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
            assert Counter((i, t) for i, _, t in got.elements()) == Counter((i, t) for t, i in best.items())
        elif name == "near_dedup":
            tied = near_components([(i, t) for i, _, t in rows])
            assert got == Counter(r for r in rows if tied.get((r[0], r[2]), (0, True))[1]) and got.total() < len(rows)
        elif name == "mixing":
            from tidemark.llm import mixing

            has = Counter()
            for _, s, t in rows:
                has[s or ""] += len(tokens(t))
            a = mixing.exponent(spark.createDataFrame(list(has.items()), "source string, tokens long").where("tokens > 0"), None, 2.0)
            plan = brute.schedule([(i, s or "", t, len(tokens(t))) for i, s, t in rows], a)
            assert Counter((i, s or "", len(tokens(t))) for i, s, t in got.elements()) == Counter((i, s, n) for _, i, s, _, n in plan.elements())
            assert {(i, t) for i, _, t in got} == {(i, t) for i, _, t in rows}
        rows = list(got.elements())
    pieces = Counter()
    for r in docs.collect():
        pieces[r.doc_id] += r.length
    want = Counter()
    for i, _, t in rows:
        want[i] += len(tokens(t)) + 1
    assert pieces == want


def test_near_dedup_stage_keeps_another_text_of_an_id_that_goes(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (2, "something else that is like nothing at all"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert Counter(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, "").collect())) == Counter([rows[0], *rows[2:]])


def test_exact_dedup_stage_carries_clashing_names_and_settles_repeats(spark):
    rows = [(1, "a", "x", 1), (1, "a", "y", 2), (2, "b", None, 3), (None, "a", "z", 4), (None, None, "n", 5), (None, "", "m", 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, __sha string, row int")
    first = corpus_pipeline.exact_dedup_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in first) == [(0, ""), (1, "a"), (2, "b")]
    assert Counter(first) == Counter(corpus_pipeline.exact_dedup_stage(spark, docs.orderBy("row", ascending=False), "").collect())
    assert first[0].asDict().keys() == {"doc_id", "text", "__sha", "row"}


def test_run_leaves_only_what_its_result_reads(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.plans.scratch.scratch_root", lambda spark: f"file://{tmp_path}/scratch")
    assert corpus_pipeline.run(spark, corpus(awkward())).count() > 10
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "scratch/tidemark").iterdir() if any(p.glob("*.parquet"))}
    assert left == {"mixing", "pack"}


def test_an_empty_corpus(spark, corpus):
    assert corpus_pipeline.run(spark, corpus([])).count() == 0


def test_every_stage_carries_columns_of_any_name(spark, corpus):
    """Columns named like those that the stages make themselves, of every kind of type that Parquet holds."""
    from pyspark.sql import functions as F

    d = corpus([])
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(40)), None if i % 5 == 0 else "s") for i in range(40)] + [(50, None, "s"), (None, "x y", "s")]
    names = "gone_id gone_sha id text_sha sha key row row_id row_sha plan_id plan_source plan_key text_key block place epoch tokens has budget at within source_id of keep_id kept rows".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *(F.coalesce("doc_id", F.lit(-1)).alias(n) for n in names), F.make_dt_interval(F.lit(1)).alias("count"), F.create_map(F.lit("k"), F.lit(1)).alias("label"))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        got = out.collect()
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(r[n] == (-1 if r.doc_id is None else r.doc_id) for r in got for n in names), name
        assert len(got) >= 10, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() > 0
