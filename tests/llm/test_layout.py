"""Mixing, sharding and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD, prose
from pyspark.sql import functions as F

import corpus_pipeline
from finwake.llm import catalog, mixing, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [ODD, [(i, prose(3, i)) for i in range(103)], []])
def test_shards(frame, rows):
    docs = frame(rows)
    got = sharding.digest(docs, 8).collect()
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=str) == sorted(
        [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows], key=str
    )
    by = Counter(r["shard"] for r in got)
    if rows:
        counts = [by.get(s, 0) for s in range(8)]
        assert max(counts) - min(counts) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(by[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_shards_do_not_depend_on_partitions(frame):
    docs = frame([(i, prose(4, i)) for i in range(200)])
    key = lambda df: sorted((r.doc_id, r["shard"], r.slot) for r in df.collect())
    one = sharding.shuffle_into_shards(docs.coalesce(1), bucket_bytes=1 << 10)
    a = key(one)
    # the number of buckets follows the size estimate, so it is held by the same frame in another order
    b = key(sharding.shuffle_into_shards(docs.orderBy(F.desc("doc_id")).coalesce(1), bucket_bytes=1 << 10))
    assert [x[0] for x in a] == [x[0] for x in b] == list(range(200))
    assert a == b
    assert "copies" in one.columns
    with pytest.raises(ValueError, match="shard"):
        sharding.shuffle_into_shards(docs.withColumn("Shard", F.lit(1)))


def test_copies_are_scattered_like_other_rows(frame):
    docs = frame([(5, "copy")] * 1000 + [(i, prose(4, i)) for i in range(100, 1100)]).repartition(4)
    got = sharding.shuffle_into_shards(docs, 8, bucket_bytes=1 << 12).collect()
    n = Counter(r["shard"] for r in got if r.doc_id == 5)
    assert sum((n[s] - 125) ** 2 / 125 for s in range(8)) < 24.3  # chi-square, 7 degrees of freedom, 0.999
    place = np.array([r.position for r in got if r.doc_id == 5])
    assert len({r.position for r in got}) == 2000 and abs(place.mean() - 1000) < 60


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(4, 1, b).tolist()) for b in range(12_000))
    assert len(seen) == 24 and all(abs(n - 500) < 120 for n in seen.values())


def test_mixing_meets_targets(spark, frame):
    rows = [(i, "x" * 99) for i in range(6000)]
    docs = frame(rows)
    got = mixing.mix(docs, {"src0": 1, "src1": 3, "src2": 0}, epochs=2.0)
    assert set(docs.columns) <= set(got.columns) and "_copies" in got.columns
    n = Counter(r.source for r in got.select("source").collect())
    assert set(n) == {"src0", "src1"} and abs(n["src0"] - 3000) < 250 and abs(n["src1"] - 9000) < 450
    per = Counter(r.n for r in got.filter("source = 'src1'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    lam = 4.5
    for k in range(1, 10):
        p = np.exp(-lam) * lam**k / np.prod(np.arange(1, k + 1))
        assert abs(per[k] / 2000 - p) < 0.04
    order = [r.shuffle_key for r in got.coalesce(1).sortWithinPartitions("shuffle_key").collect()]
    assert len(set(order)) == len(order)


def test_mixing_of_large_rates_and_odd_rows(frame):
    got = mixing.mix(frame(ODD), epochs=300.0).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in got) > 1000
    assert mixing.mix(frame([])).count() == 0
    with_null = frame(ODD).withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(with_null, epochs=3.0).count() > 5


def test_pipeline_on_planted_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = docs.filter("doc_id = 1").first()
    new = spark.createDataFrame(
        [(9001, "Of this " + item + " and that.", "en", "src1", 1), (9002, clean.text, "en", "src2", 1), (9003, None, None, None, None)],
        docs.schema,
    )
    docs.unionByName(new).write.parquet(str(tmp_path / "documents.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in current.select("doc_id").collect()}
    assert 9002 not in left["near_dedup"] and 9001 not in left["decontamination"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1}
    assert len(good & left["quality"]) >= 0.95 * len(good)
    out = corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path))
    assert out.count() == current.count() and {"shard", "slot"} <= set(out.columns)


def test_stages_decide_row_by_row(spark, frame, tmp_path):
    good = [prose(120, 500 + k) for k in range(6)]
    passage = prose(40, 900)
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held = prose(60, 901) + " " + passage + " " + prose(60, 902)
    rows = [(None, good[0]), (None, good[1]), (None, held), (7, good[2]), (7, good[3]), (7, held + " x"), (8, good[4]), (None, good[5])]
    out = corpus_pipeline.decontamination_stage(spark, frame(rows), str(tmp_path))
    assert sorted(r.text for r in out.collect()) == sorted(good)
    copies = [(None, good[0] + " tail"), (3, good[1]), (7, good[2] + " end"), (9, good[4])]
    out = corpus_pipeline.near_dedup_stage(spark, frame([(i, t) for i, t in rows if t in good] + copies), str(tmp_path))
    got = sorted((r.doc_id if r.doc_id is not None else -1, good.index(next(g for g in good if r.text.startswith(g)))) for r in out.collect())
    assert got == [(-1, 0), (-1, 5), (3, 1), (7, 2), (7, 3), (8, 4)]
    # one bad row of a hot id and of the null ids
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kinds = {q: docs.join(labels.filter(f"quality = {q}"), "doc_id").select(docs.columns) for q in (0, 1)}
    odd = kinds[1].orderBy("doc_id").limit(12).unionByName(kinds[0].orderBy("doc_id").limit(4))
    for new in (None, -5):
        mixed = docs.unionByName(odd.withColumn("doc_id", F.lit(new).cast(docs.schema["doc_id"].dataType)))
        out = corpus_pipeline.quality_stage(spark, mixed, str(tmp_path)).filter(F.col("doc_id").eqNullSafe(F.lit(new)))
        assert 8 <= out.count() <= 13


def test_catalogue():
    q = catalog.queries()
    assert [f"op{n}" for n in range(1, 14)] == sorted({k.split("_")[0] for k in q}, key=lambda s: int(s[2:]))
    assert set(catalog.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op6_mixing"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in catalog.queries()[name](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_mixing_keeps_columns_named_like_its_own(frame):
    docs = frame([(i, f"text {i}") for i in range(50)]).withColumns({c: F.lit(c) for c in ("_source", "_rate", "_parts", "_cdf", "_bytes")})
    got = mixing.mix(docs, epochs=2.0).collect()
    assert got and all((r["_source"], r["_rate"], r["_parts"], r["_cdf"]) == ("_source", "_rate", "_parts", "_cdf") for r in got)


def test_stages_keep_a_column_named_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_row", F.lit(77))
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.near_dedup_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.filter("_row = 77").count() == out.count()
