"""Whole queries over tables with clashing columns, and with every join shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from wavequery.llm import common, exact_dedup, registry, suffix_dedup

from tests.llm.test_operators import docs, nothing, removed, rows, text  # noqa: F401

CLASHING = ["label", "part", "x", "k", "c", "d", "n", "u", "v", "h", "blob", "scan", "spans", "score", "kept", "root", "set", "row", "terms", "tf", "term", "item", "mask", "digest", "held", "block", "bucket", "keys", "name", "position", "size"]


@pytest.fixture(scope="module")
def folders(spark, docs, tmp_path_factory):  # noqa: F811
    """The same tables, plain and with columns that operators use themselves."""
    base = tmp_path_factory.mktemp("tables")
    tables = {
        "documents": docs.where("doc_id <> 404").withColumn("lang", F.col("source")),
        "labels": docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 % 2).cast("int").alias("toxic")).where("doc_id < 300"),
        "benchmark": docs.where("doc_id < 3").select(F.col("doc_id").alias("item_id"), "text"),
    }
    for name, df in tables.items():
        df.coalesce(2).write.parquet(f"{base}/plain/{name}.parquet")
        extra = [c for c in CLASHING if c not in df.columns]
        df.coalesce(2).select(*[F.lit("clash").alias(c) for c in extra[::2]], "*", *[F.array(F.lit(1)).alias(c) for c in extra[1::2]]).write.parquet(f"{base}/clashing/{name}.parquet")
    return str(base)


def rounded(r):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in r)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op6", "op8", "op11", "op12", "op13")])
def test_clashing_columns(spark, folders, name):
    plain, clashing = (registry.QUERIES[name](spark, f"{folders}/{x}") for x in ("plain", "clashing"))
    assert plain.schema == clashing.schema
    own = [c for c in plain.columns if c not in ("new_blob",)]
    assert sorted(map(rounded, plain.select(own).collect()), key=str) == sorted(map(rounded, clashing.select(own).collect()), key=str)


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Nothing is broadcast because it is short: as with very many keys."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def test_ids_are_shuffled(spark, shuffled):
    rows_ = [(i % 50, f"t{i}") for i in range(200)]
    df, ids = spark.createDataFrame(rows_, "doc_id long, text string"), common.stash(spark.range(20).select(F.col("id").alias("doc_id")), "ids")
    for out, keep in ((common.keep_ids(df, ids), True), (common.drop_ids(df, ids), False)):
        got = out.collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got)) == sorted(r for r in rows_ if (r[0] < 20) == keep)


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op3_secret_scan", "op12_ranked_search"])
def test_queries_without_broadcasts_of_counted_sides(spark, folders, shuffled, name):
    got = registry.QUERIES[name](spark, f"{folders}/plain")
    got = sorted(map(str, got.drop("new_blob").collect()))
    for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(n)
    assert got == sorted(map(str, registry.QUERIES[name](spark, f"{folders}/plain").drop("new_blob").collect()))


def test_suffix_dedup_without_broadcasts(spark, docs, rows, shuffled):  # noqa: F811
    out = suffix_dedup.deduplicate(docs, with_bytes=False)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in out.collect())
    assert got == removed(rows, suffix_dedup.LENGTH, False)


def test_exact_dedup_and_mixing_of_a_text_of_30_mb(spark):
    """Both are expressions of the JVM: one long text beside short ones."""
    long = F.repeat(F.lit("word and other words "), 1_500_000)
    df = spark.createDataFrame([(1, "short"), (2, "short"), (3, None)], "doc_id long, text string").withColumn("source", F.lit("s"))
    df = df.unionByName(spark.range(4, 6).select(F.col("id").alias("doc_id"), long.alias("text"), F.lit("s").alias("source")))
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(df).collect()}
    assert groups == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (5, 2), 5: (5, 2)}
    from wavequery.llm import mixing

    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    assert sizes == {1: 1, 2: 1, 3: 0, 4: 6_000_000, 5: 6_000_000}


def test_many_copies_of_one_id(spark, monkeypatch):
    """op8 over rows that share one id, and rows without any: all are there."""
    from wavequery.llm import winnowing

    rng = random.Random(4)
    data = [(7, text(rng, 12)) for _ in range(60)] + [(None, text(rng, 12)) for _ in range(60)] + [(8, text(rng, 12))]
    spark.createDataFrame(data, "doc_id long, text string").createOrReplaceTempView("hot_ids")
    df = spark.table("hot_ids")
    monkeypatch.setattr(winnowing, "read_documents", lambda s, d: df)
    got = winnowing.op8_winnow_fingerprints(spark, "")
    assert sorted(r["doc_id"] or -1 for r in got.select("doc_id").collect()) == sorted(i or -1 for i, _ in data)
