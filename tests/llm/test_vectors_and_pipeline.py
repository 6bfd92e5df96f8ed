"""Embedding near-duplicates against all pairs, and the pipeline stage by stage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import vectors
from pagesieve.llm.queries import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)  # so that lists are split
    random = np.random.default_rng(3)
    rows = random.standard_normal((500, 16))
    rows[100:220] = rows[0] + 0.08 * random.standard_normal((120, 16))  # a cloud around one vector
    rows[220:260] = rows[1] * random.uniform(0.5, 2, (40, 1))  # copies but for their length
    rows[260:300] = rows[2]
    labels = [None if k % 50 == 49 else k % 3 for k in range(500)]
    data = [(k, [float(x) for x in r], l) for k, (r, l) in enumerate(zip(rows, labels))]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [], 1), (504, [None] * 16, 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1)]
    found = vectors.near_vectors(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    link = (unit @ unit.T >= 0.98) & same & ~np.eye(500, dtype=bool)
    component = np.arange(500)
    for _ in range(500):
        new = np.array([min(component[k], component[link[k]].min(initial=500)) for k in range(500)])
        if (new == component).all():
            break
        component = new
    assert (found.loc[range(500), "n_links"].to_numpy() == link.sum(1)).all()
    assert (found.loc[range(500), "component_id"].to_numpy() == component).all()
    assert found.loc[range(500, 505), "n_links"].tolist() == [0] * 5 and found.loc[506, "component_id"] == 505
    assert (found["kept"] == (found["component_id"] == found.index)).all()


def test_an_empty_table_gives_no_rows(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_every_query_runs_on_the_smallest_tables(spark):
    queries = all_queries()
    assert set(all_oracles()) <= set(queries) and len(queries) == 14
    for name in ("op6_secret_scan", "op7_pii", "op10_decontamination"):
        assert queries[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_keep_columns_and_act_on_what_their_operators_say(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty(), name
    assert docs.where(r"text rlike '[A-Za-z0-9._%+-]@[A-Za-z0-9-]+[.]'").isEmpty()
    pieces = pipeline.packing_stage(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_the_near_duplicate_stage_leaves_one_row_of_each_group(spark, odd_documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = pipeline.near_duplicate_stage(spark, odd_documents, SF).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8] and len(kept) == 8


def test_redaction_keeps_columns_of_any_name(spark):
    from pagesieve.llm import pii

    names = "doc_id long, text string, _base string, _spans int, _done string, _email string, _ip string, _row int, _text string"
    rows = [(1, "write to a.b@example.com now", "b", 7, "d", "e", "i", 5, "t"), (2, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, names).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    found = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert tuple(found[1]) == (1, "write to <EMAIL> now", "b", 7, "d", "e", "i", 5, "t", {"k": 1})
    assert tuple(found[2])[:9] == rows[1]


def test_repeated_rows_keep_columns_of_any_name_and_type(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "some words of a text that is long enough", 5, 6, 7)] * 3 + [(2, "another text", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, row int, _at int").withColumn("m", F.create_map(F.lit("k"), F.col("at")))
    kept = sorted(map(tuple, pipeline.near_duplicate_stage(spark, docs, SF).collect()))
    assert kept == [(1, rows[0][1], 5, 6, 7, {"k": 5}), (2, "another text", 1, 2, 3, {"k": 1})]


def test_stages_take_odd_and_empty_tables(spark, odd_documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd = odd_documents.withColumn("_base", F.lit("x")).withColumn("at", F.lit(1))
    texts = {r.text for r in odd.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns, name
        assert {r.text for r in kept.collect()} <= texts, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    assert pipeline.packing_stage(spark, odd.limit(0), SF).count() == 0


def test_the_filtering_stages_keep_what_a_plain_version_keeps(spark):
    import re

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes, clean = {len(w) for w in windows}, set()
    for doc_id, text in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(doc_id)
    assert {r.doc_id for r in pipeline.decontamination_stage(spark, docs, SF).collect()} == clean
    shingles = {}
    for doc_id, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        shingles[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in texts}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, SF).collect()} == {d for d in ids if root(d) == d}


def test_a_hashed_sample_is_the_same_for_any_partitioning(spark):
    from pagesieve.llm.common import hashed_sample

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    best = {r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(500).collect()}
    for parts in (1, 64):
        sample = hashed_sample(rows.repartition(parts), "doc_id", 500)
        assert {r.doc_id for r in sample.collect()} == best
    assert hashed_sample(rows, "doc_id", 30_000).count() == 20_000 and hashed_sample(rows.limit(0), "doc_id", 5).count() == 0
