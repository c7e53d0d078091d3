"""The pipeline's stages against brute force on a small table, and on odd tables."""

import re

import pytest
from test_blocks import brute_targets
from test_dedup import brute_lines, brute_similar
from test_scoring import brute_contamination

import corpus_pipeline
from sluice.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs of the stages and the last one's output."""
    out = [spark.read.parquet(f"{SF}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def _rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chosen = {r.id for r in quality.select(stages[0], labels).where("selected").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == chosen
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(kept & good) > 0.97 * len(good) and len(kept) < stages[0].count()


def test_line_stage(stages):
    before = sorted((r.doc_id, r.source, r.text) for r in stages[1].collect())
    want = brute_lines([(s, t) for _, s, t in before], corpus_pipeline.BOILERPLATE_RATIO, 4)
    assert _rows(stages[2]) == [(d, t) for (d, _, _), t in zip(before, want)]
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_line_stage_reaches_rare_lines_of_large_sources(spark):
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, "\n".join([f"own line {i}", *[passage] * (i % 500 == 0), *["notice"] * (i % 1000 == 1), *["thrice"] * (i < 3)]), "large") for i in range(5000)]
    rows += [(9000 + i, f"own line {i}\n{passage}", "small") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = dict(_rows(corpus_pipeline.drop_boilerplate_lines(spark, docs, SF)))
    want = brute_lines([(s, t) for _, t, s in rows], corpus_pipeline.BOILERPLATE_RATIO, 4)
    assert [got[d] for d, _, _ in rows] == want
    assert got[500] == "own line 500" and got[0] == "own line 0\nthrice" and got[1] == "own line 1\nnotice\nthrice"
    assert got[9000] == rows[5000][1]


def test_dedup_stage(stages):
    before = _rows(stages[2])
    component = brute_similar([d for d, _ in before], [t for _, t in before])
    assert _rows(stages[3]) == [(d, t) for (d, t), c in zip(before, component) if d == c]


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = _rows(stages[3])
    dirty = {r[0] for r in brute_contamination(before, items) if r[5]}
    assert _rows(stages[4]) == [(d, t) for d, t in before if d not in dirty]


def test_mix_stage(stages):
    source, size = {}, {}
    for r in stages[4].collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        source[r.doc_id] = r.source
        size[r.source] = size.get(r.source, 0) + n
    want, taken = brute_targets(size), {}
    for r in stages[5].collect():
        s = source.pop(r.doc_id)
        assert r.source_size == size[s] and r.taken <= 2 * r.size and r.target == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r.taken
    assert not source and all(abs(taken[s] - want[s]) < 1 for s in size)


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_odd_documents_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, text_hash string"
    rows = [(None,) * 8, (1, None, "en", "s", 0, 1, "a", "b"), (2, "", "en", None, 0, 1, "a", "b"), (2, "", "en", None, 0, 1, "a", "b"), (3, "The and that " * 30_000, None, "s", None, None, None, None), (4, "The and that\nis of", "en", "s", 1, 1, "x", "y"), (4, "The and that\nis of", "en", "s", 1, 1, "x", "y")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            docs.count()
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.count() == docs.count()
        assert not table or out.count() >= 2
