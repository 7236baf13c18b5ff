import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spokeworks.llm import metric_join, quality, secret_scan
from spokeworks.llm.queries import POWERS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage keeps, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name.replace(" ", "-"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def brute_survivors(rows):
    """The ids that stay when all pairs of sets of five-word shingles are compared."""
    sets = [set(metric_join.shingles(r.text or "", 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] == sets[j] or same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.doc_id)
    return {min(g) for g in groups.values()}


def test_stages_keep_the_columns_and_exactly_the_rows_of_brute_force(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = docs.collect()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r, s in zip(rows, model.score(np.array([quality.features(r.text) for r in rows])), strict=True) if s >= 0.3}
    assert {r.doc_id for r in kept[0].collect()} == good
    left = {r.doc_id for r in kept[1].collect()}
    assert left == brute_survivors(kept[0].collect()) and 0 < len(left) < len(good)
    before, after = ({r.doc_id: r for r in k.collect()} for k in kept[1:3])
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values())
    found = secret_scan.find_secrets(kept[1], secret_scan.train(kept[1])).collect()
    assert all((before[r.doc_id].text != after[r.doc_id].text) == bool(r.spans) for r in found)
    assert not any(before[r.doc_id].text[s.start : s.end] in after[r.doc_id].text for r in found for s in r.spans)
    drawn = {r.doc_id for r in kept[3].collect()}
    again = {r.doc_id for r in corpus_pipeline.mixing.mix(kept[2], powers=POWERS).collect() if r.kept}
    assert drawn == again and 0 < len(drawn) <= len(left)
    pieces = kept[4].collect()
    assert {r.doc_id for r in pieces} == drawn and all(len(r.ids) == r.length for r in pieces)


def test_run_gives_what_the_stages_give_and_takes_up_a_named_job(spark, kept, tmp_path, monkeypatch):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(tuple(r[c] for c in columns) for r in df.collect())
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    assert rows(corpus_pipeline.run(spark, SF, job="a")) == rows(kept[-1])
    asked = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*((n, lambda *a: asked.append(a)) for n, _ in corpus_pipeline.STAGES[:-1]), corpus_pipeline.STAGES[-1]])
    assert rows(corpus_pipeline.run(spark, SF, job="a")) == rows(kept[-1]) and not asked
    corpus_pipeline.remove(spark, "a")
    assert not list(tmp_path.glob("pipeline-*"))


def test_stages_stand_null_empty_and_repeated_rows_and_empty_tables(spark):
    rng = random.Random(3)
    words = "the of and to in is it on that with for was by are from at this be or an".split()
    texts = [None, "", " \n", *(" ".join(rng.choices(words, k=50)).capitalize() + "." for _ in range(30)), "x " * 100_000]
    rows = [(k, t, ("en", None)[k % 7 == 0], ("s1", None)[k % 5 == 0], k) for k, t in enumerate(texts)] + [(None, None, None, None, None), (None, "a b", "en", "s1", 3)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    docs = docs.unionByName(docs)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and out.count() > 0, name
        assert name == "best-fit packing" or out.columns == docs.columns
    once = corpus_pipeline.near_duplicates(spark, docs, SF).filter("doc_id is not null")
    assert once.count() == once.select("doc_id").distinct().count() and once.filter(F.trim(F.coalesce("text", F.lit(""))) == "").count() <= 2
