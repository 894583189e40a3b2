import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_contamination import brute as contained
from test_line_dedup import brute as deduped
from brute import groups, simhash

import __spark_entry__ as entry_points
from weirlog.llm import quality
from weirlog.llm.catalog import trusted_ids
from weirlog.session import new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, out[-1], SF).write.parquet(folder)
        out.append(spark.read.parquet(folder))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(outputs):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == outputs[0].columns and df.dtypes == outputs[0].dtypes for df in outputs[1:5])


def test_quality(spark, outputs):
    judged = quality.judge(outputs[0], trusted_ids(spark, SF)).where("keep")
    assert sorted(r.doc_id for r in outputs[1].collect()) == sorted(r.doc_id for r in judged.collect())
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in outputs[1].collect()}
    assert len(good & kept) > 0.97 * len(good)


def test_line_dedup(outputs):
    expected = {tuple(eval(r)[:2]) for r in deduped(rows(outputs[1]))}
    assert set(rows(outputs[2])) == expected
    assert all(r.n_chars == len(r.text) for r in outputs[2].collect())


def test_near_duplicates(outputs):
    given = rows(outputs[2])
    prints = sorted({simhash(t) for _, t in given})
    root = groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t in given:
        least[root[simhash(t)]] = min(i, least.get(root[simhash(t)], i))
    assert sorted(i for i, _ in rows(outputs[3])) == sorted(least.values())


def test_decontamination(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = [i for i, t in rows(outputs[3]) if not contained([(i, t)], items)]
    assert sorted(i for i, _ in rows(outputs[4])) == sorted(expected)


def test_packing(outputs):
    packed = outputs[5]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in rows(outputs[4])}
    assert packed.groupBy("bin_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_registered(spark):
    found = entry_points.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11))
    assert found["pipeline"](spark, SF).count() > 0
