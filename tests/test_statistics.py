"""Characteristic sets, bit vectors and streams that meet."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import bitvec as B
from graphloom.operators import relalg as M
from graphloom.operators.store import GraphStore
from graphloom.plans import planner
from graphloom.plans.executor import Engine
from graphloom.plans.syntax import parse
from graphloom.streaming.match import match_streams

from .conftest import rows

SCHEMA = "s string, p string, o string"


@pytest.fixture(scope="module")
def skewed(spark):
    """Many subjects with <a>, many others with <b>, hardly any with both; those with <a> have all a name."""
    data = [(f"<x{i}>", "<a>", f"<v{i % 50}>") for i in range(400)] + [(f"<y{i}>", "<b>", f"<v{i % 50}>") for i in range(500)] + [(f"<x{i}>", "<b>", f"<w{j}>") for i in range(2) for j in range(3)]
    data += [(f"<x{i}>", "<name>", f'"n{i}"') for i in range(400)]
    return GraphStore.from_triples(spark.createDataFrame(data, SCHEMA)).analyze()


def patterns(text):
    return parse(f"SELECT * {{ {text} }}").where.patterns


def test_stars_are_estimated_by_what_goes_together(skewed):
    assert sorted((sorted(has), n) for has, n in skewed.sets) == [(["<a>", "<b>", "<name>"], 2), (["<a>", "<name>"], 398), (["<b>"], 500)]
    for text in ("?x <a> ?v . ?x <b> ?w", "?x <a> ?v . ?x <name> ?n", "?x <b> ?w . ?x <name> ?n", "?x <a> ?v . ?x <b> ?w . ?x <name> ?n"):
        true = Engine(skewed).query(f"SELECT * {{ {text} }}").count()
        assert true / 2 <= planner.star(patterns(text), skewed) <= 2 * true, text


def test_the_order_follows_them(skewed):
    # by counts alone <name> (400) comes before <b> (506); but hardly any <a> has a <b>
    found = patterns("?x <a> ?v . ?x <name> ?n . ?x <b> ?w")
    plain = GraphStore(skewed.spark, skewed.table, stats=skewed.stats)
    assert planner.order(found, [0, 1, 2], plain)[-1] == 2
    assert planner.order(found, [0, 1, 2], skewed).index(2) == 1
    text = "SELECT ?x ?n ?w { ?x <a> ?v . ?x <name> ?n . ?x <b> ?w }"
    assert rows(Engine(skewed).query(text)) == rows(Engine(plain).query(text)) and Engine(skewed).query(text).count() == 6


def test_few_sets_and_none(spark, skewed):
    assert len(GraphStore(spark, skewed.table).analyze(most=1).sets) == 1
    empty = GraphStore.from_triples(spark.createDataFrame([], SCHEMA)).analyze()
    assert empty.sets == [] and rows(Engine(empty).query("SELECT ?x { ?x <a> ?y . ?x <b> ?z }")) == []


def test_bit_vectors_match_relations(spark):
    rng = random.Random(2)
    cells = list({(rng.randrange(300), rng.randrange(300)) for _ in range(500)})
    m = spark.createDataFrame(cells, "u bigint, v bigint")
    some, more = (spark.createDataFrame([(i,) for i in rng.sample(range(300), 90)], "v bigint") for _ in range(2))
    a, b = B.of_ids(some, "v"), B.of_ids(more, "v")
    assert rows(B.ids(a)) == rows(some) and B.size(a).first().n == 90 and a.count() <= 5
    for limit in (B.BROADCAST, -1):
        assert rows(B.masked(m, "v", a, limit)) == rows(M.mask_cols(m, some))
    assert rows(B.ids(B.mxv(m, a))) == rows(M.mxv(m, some)) and rows(B.ids(B.mxv_trans(m, a))) == rows(M.mxv_trans(m, some))
    assert rows(B.ids(B.vandv(a, b))) == rows(M.vandv(some, more)) and rows(B.ids(B.vorv(a, b))) == rows(some.union(more).distinct())
    assert rows(B.binding_matrix(m, a, b)) == rows(M.binding_matrix(m, some, more))
    none = B.of_ids(some.limit(0), "v")
    assert rows(B.ids(none)) == [] and B.size(none).first().n == 0 and rows(B.masked(m, "u", none)) == []
    edge = spark.createDataFrame([(0,), (63,), (64,), (2**40 + 63,), (None,)], "v bigint")
    assert rows(B.ids(B.of_ids(edge, "v"))) == [(0,), (2**40 + 63,), (63,), (64,)]


def test_a_mask_does_not_shuffle_the_layer(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("u"), (F.col("id") % 99).alias("v")).write.parquet(str(tmp_path / "m"))
    vector = B.of_ids(spark.range(10).withColumnRenamed("id", "v"), "v")
    plan = B.masked(spark.read.parquet(str(tmp_path / "m")), "v", vector)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_streams_that_meet(spark, tmp_path):
    """Pairs within the bound by event time; what comes later than lateness is left out; the rest of the query is met by the store."""
    import os

    batches = [
        [("<u>", "<c>", '"1"', "2024-01-01 10:00:00"), ("<u>", "<b>", '"2"', "2024-01-01 10:30:00"), ("<u>", "<b>", '"3"', "2024-01-01 12:00:00"), ("<w>", "<c>", '"4"', "2024-01-01 10:00:00")],
        [("<u>", "<c>", '"5"', "2024-01-01 12:30:00"), ("<z>", "<c>", '"6"', "2024-01-02 12:00:00"), ("<z>", "<b>", '"6b"', "2024-01-02 12:00:00")],
        [("<q>", "<c>", '"9"', "2024-01-02 12:01:00"), ("<q>", "<b>", '"10"', "2024-01-03 12:01:00")],
        [("<q>", "<c>", '"11"', "2024-01-02 12:02:00")],  # Spark judges lateness by what the batch before knew
        [("<u>", "<b>", '"7"', "2024-01-01 10:10:00"), ("<z>", "<b>", '"8"', "2024-01-02 12:59:00")],  # the first of them is late
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "s string, p string, o string, at string").select("s", "p", "o", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        (source,) = (tmp_path / f"b{i}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.utime(source, (1_700_000_000 + i * 100,) * 2)
        source.rename(tmp_path / "in" / f"{i}.parquet")
    store = GraphStore.from_triples(spark.createDataFrame([("<u>", "<kind>", "<k>"), ("<z>", "<kind>", "<k>")], SCHEMA))
    stream = spark.readStream.schema("s string, p string, o string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = match_streams({0: stream, 1: stream}, store, 'SELECT ?x ?c ?b { ?x <c> ?c . ?x <b> ?b . ?x <kind> <k> FILTER (?b != "6b") }', "1 hour", "2 hours")
    query = found.writeStream.format("memory").queryName("met").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("met").select("x", "c", "b")) == sorted([("<u>", '"1"', '"2"'), ("<u>", '"5"', '"3"'), ("<z>", '"6"', '"8"')], key=repr)
    with pytest.raises(ValueError):
        match_streams({0: stream, 1: stream}, store, "SELECT ?x ?y { ?x <c> ?c . ?y <b> ?b }")
