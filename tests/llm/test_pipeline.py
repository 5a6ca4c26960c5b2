"""The stages of the corpus pipeline against brute force."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_operators import brute_links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], SF).cache())
    return found


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [df.count() > 0 for df in stages] == [True] * 6


def test_language_keeps_clean_documents(stages):
    gone = stages[0].select("doc_id", "text").exceptAll(stages[1].select("doc_id", "text"))
    assert gone.count() <= 0.02 * stages[0].count()


def test_quality_drops_the_labelled_bad_and_keeps_the_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = (df.join(labels, "doc_id").groupBy("quality").count().collect() for df in stages[1:3])
    before, after = dict(map(tuple, before)), dict(map(tuple, after))
    assert after[1] >= 0.98 * before[1] and after.get(0, 0) <= 0.2 * before[0]


def test_one_of_each_group_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    _, root = brute_links(rows)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for k, (i, _) in enumerate(rows) if root[k] == k)


def test_mix_and_packing_hold_every_copy(stages):
    taken = collections.Counter(r.doc_id for r in stages[4].collect())
    assert max(taken.values()) <= 3
    first = stages[5].where("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in first} == dict(taken)
    full = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("offset").alias("d"))
    assert full.where("n > 2048 OR k != d").count() == 0


def test_stages_take_an_empty_table_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (1, "twice the same", "en", "a", 1), (1, "twice the same", "en", "a", 1)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0
