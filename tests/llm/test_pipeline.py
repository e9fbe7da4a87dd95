from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm.queries import QUERIES

from .test_dedup import key, removed, shingles


def test_stages_and_rows(spark, sf_dir):
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs
    callers = spark.range(5).cache()
    before = kept().size()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r["doc_id"] for r in rows} <= ids
    assert callers.is_cached and kept().size() == before
    callers.unpersist()


def test_operators_give_up_what_they_keep(spark, docs):
    from palimpsest.llm.near_dedup import near_duplicates
    from palimpsest.llm.textblocks import released

    kept = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = kept().size()
    result = near_duplicates(docs)
    n = result.count()
    assert kept().size() > before
    derived = result.where("kept")
    del result
    assert kept().size() == before and 0 < derived.count() < n  # computed again where the result is gone
    derived.unpersist()
    with released():
        inner = near_duplicates(docs)
        assert inner.count() == n
        now = kept().size()
        del inner
        assert kept().size() == now  # the scope ends it
    spark.catalog.clearCache()


def test_a_failing_stage_leaves_no_folder(spark, sf_dir, monkeypatch):
    from pathlib import Path

    from palimpsest.llm.textblocks import shared_folder

    def fails(spark, docs, sf_dir):
        raise RuntimeError("no")

    folders = lambda: {p.name for p in Path(shared_folder(spark)).glob("pipeline-*")}
    before = folders()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("as_it_is", lambda s, docs, d: docs), ("fails", fails), corpus_pipeline.STAGES[-1]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf_dir)
    assert folders() == before


def test_each_stage_keeps_the_columns(spark, docs, sf_dir):
    docs = docs.where("doc_id is null or doc_id not in (20, 21)")
    columns = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns.columns, name
        assert out.dtypes == columns.dtypes, name
        assert out.count() <= docs.count()


def test_stages_against_brute_force(spark, docs, rows):
    """Each stage's rows on its own input: what lines, copies and passages leave, by plain Python."""
    docs = docs.where("doc_id is not null and doc_id not in (20, 21)").withColumn("n_chars", F.lit(0).cast("long"))
    every = {i: t or "" for i, t in rows if i not in (20, 21, None)}
    holders = defaultdict(set)
    for i, t in every.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    lines = {i: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i) for i, t in every.items()}
    found = lambda stage: {r["doc_id"]: (r["text"] or "", r["n_chars"]) for r in stage(spark, docs, "").collect()}
    assert found(corpus_pipeline.drop_lines) == {i: (t, len(t)) for i, t in lines.items()}
    sets = {i: shingles(t) for i, t in every.items()}
    gone = {b for b in sets for a in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert found(corpus_pipeline.drop_near_duplicates).keys() == every.keys() - gone
    passages = {i: (len_, left) for i, len_, left, *_ in removed(list(every.items()), 100)}
    left = found(corpus_pipeline.drop_passages)
    assert left.keys() == every.keys()
    for i, (size, cut) in passages.items():
        if all(ord(c) < 128 for c in every[i]):
            assert len(left[i][0]) == size - cut, i


def test_near_copies_from_four_fifths_on_go(spark):
    texts = []
    for k in range(12):
        # Each changed word changes five shingles: similarities from 0.75 to 0.85, two pairs at exactly 0.8.
        base = [f"w{k}x{j}" for j in range((184, 196, 215)[k % 3])]
        near = [f"new{j}" if j % 30 == 10 and j < 30 * (4 + k // 6) else w for j, w in enumerate(base)]
        texts += [" ".join(base), " ".join(near)]
    sets = [shingles(t) for t in texts]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 0.8 in share and any(0.8 < s < 0.85 for s in share) and any(s < 0.8 for s in share)
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()}
    assert left == {2 * k for k in range(12)} | {2 * k + 1 for k in range(12) if share[k] < 0.8}


def test_queries_are_named():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
