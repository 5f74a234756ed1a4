"""Variants against a baseline, plans, and the edges: empty inputs, duplicates, one bucket, few rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import dictionary
from quarry.operators import access, joins, keyset, radix, relational
from quarry.sources import tables
from quarry.sources.metrics import Runs, median_seconds


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key bigint")


def one(df):
    return df.first()[0]


def test_models_and_pushdown(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    got = relational.total(relational.select(df.select(F.col("o_custkey").alias("x")), [("<>", 1), ("<>", 2), ("<", 50)]))
    text = plan(got)
    assert "PushedFilters" in text and text.count("Filter (") <= 1 and "ReadSchema: struct<o_custkey:bigint>" in text
    volcano = relational.modelled(spark, "tuple")
    assert "*(" not in plan(relational.scan(volcano.read.parquet(f"{sf}/orders.parquet"), F.col("o_custkey")).filter("x < 3"))
    assert spark.conf.get("spark.sql.codegen.wholeStage") == "true"


def test_empty_aggregates(spark):
    none = spark.range(0).select(F.col("id").alias("x"))
    assert one(relational.total(none)) == 0 and one(relational.count(none)) == 0
    assert [tuple(r) for r in relational.count_below_each(none, F.col("x"), (1, 2)).collect()] == [(1, 0), (2, 0)]


def test_sum_overflow_raises(spark):
    big = spark.createDataFrame([(2**63 - 1,), (1,)], "x bigint")
    with pytest.raises(Exception, match="(?i)overflow"):
        relational.total(big).collect()


@pytest.mark.parametrize("n", [0, 1, 7, 63, 200])
def test_conditional_counts(spark, n):
    df = tables.uniform(spark, n)
    want = sum(r.x < 42 for r in df.collect())
    for kind in ("tinyint", "bigint"):
        for free in (True, False):
            assert one(relational.count_below(df, F.col("x").cast(kind), 42, free)) == want


STRATEGIES = [("aggregated", ()), ("broadcast", ()), ("merge", ()), *[("radix", (b,)) for b in (0, 1, 5)], ("radix", (1, 1)), ("radix", (2, 3))]


@pytest.mark.parametrize("r,s", [([], [1]), ([1], []), ([1, 1, 2], [1, 1, 3, 2]), (list(range(50)), list(range(25, 40))), ([0, 2**40], [2**40] * 3)])
def test_join_strategies(spark, r, s):
    left, right = keys(spark, r), keys(spark, s)
    for strategy, bits in STRATEGIES:
        assert one(joins.semi_count(left, right, strategy, bits)) == sum(x in set(r) for x in s), strategy
    assert one(joins.inner_count(left, right)) == sum(a == b for a in r for b in s)
    assert {x.key for x in joins.key_intersection(left, right).collect()} == set(r) & set(s)


def test_join_plans(spark, sf):
    r = joins.keys_of(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey")
    s = joins.keys_of(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_partkey")
    assert "BroadcastHashJoin" in plan(joins.semi_count(r, s, "broadcast"))
    assert "ShuffledHashJoin" in plan(joins.semi_count(r, s, "radix", (3,)))
    assert "SortMergeJoin" in plan(joins.semi_count(r, s, "merge"))
    assert "LeftSemi" in plan(joins.semi_count(r, s))


def test_radix(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1000)) for i in range(500)]
    df = spark.createDataFrame(rows, "rid bigint, key bigint")
    for bits in (0, 1, 4):
        want = {i: p for p, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1] & ((1 << bits) - 1), x[0])))}
        got = radix.positions(df, bits, "key", "rid", chunk=64)
        assert {r.rid: r.pos for r in got.collect()} == want
        assert sum(r.astray for r in radix.misplaced(df, bits).collect()) == 0


def test_dictionary_variants(spark):
    df = tables.packed_bytes(spark, 300)
    want = sorted((2 * r.pos + k, dictionary.NIBBLES[c]) for r in df.collect() for k, c in enumerate((r.b >> 4, r.b & 15)))
    for f in (dictionary.decode_scalar, dictionary.decode_table, dictionary.decode_array, dictionary.decode_map):
        assert sorted((r.out_pos, r.value) for r in f(df).collect()) == want


@pytest.mark.parametrize("n", [1, 2, 5, 37])
@pytest.mark.parametrize("stride", [1, 3, 8])
def test_cycles(spark, n, stride):
    ids = spark.range(n)
    order = [i for o in range(min(stride, n)) for i in range(o, n, stride)]
    want = {a: b for a, b in zip(order, order[1:] + order[:1])}
    assert {r.id: r.next for r in access.strided(ids, stride).collect()} == want
    back = [n - 1 - i for i in order]
    assert {r.id: r.next for r in access.strided_back(ids, stride).collect()} == {a: b for a, b in zip(back, back[1:] + back[:1])}


def test_random_cycle_and_traversal(spark):
    cycle = access.shuffled(spark.range(100), prefix=1)
    step = {r.id: r.next for r in cycle.collect()}
    seen, at = [], 0
    for _ in range(100):
        seen.append(at)
        at = step[at]
    assert at == 0 and sorted(seen) == list(range(100))
    assert tuple(access.traversed(cycle, 100).first()) == (100, 100, 100)
    assert {r.id: r.at for r in access.hops(cycle, 3).collect()} == {i: step[step[step[i]]] for i in range(100)}


def test_replay(spark):
    log = tables.operation_log(spark, 700, domain=9)
    rows = keyset.replay(log, F.col("key") < 4, block=50).orderBy("i").collect()
    state = set(range(4))
    for r in rows:
        assert r.present == (r.key in state)
        if r.op == "insert":
            assert r.result == (r.key not in state)
            state.add(r.key)
        elif r.op == "remove":
            assert r.result == (r.key in state)
            state.discard(r.key)
    start = spark.range(4).select(F.col("id").alias("key"))
    assert {r.key for r in keyset.final_state(log, start).collect()} == state


def test_set_edges(spark):
    none, some = keys(spark, []), keys(spark, [3, 1, 3])
    assert [r.key for r in keyset.ordered(keyset.insert(none, some)).collect()] == [1, 3]
    assert keyset.remove(some, keys(spark, [7])).count() == 2 and keyset.remove(none, some).count() == 0
    assert one(keyset.contains_count(none, some)) == 0 and one(keyset.contains_count(some, keys(spark, [3, 3, 2]))) == 2


def test_generators_and_files(spark, tmp_path):
    assert tables.unique_keys(spark, 1000).distinct().count() == 1000
    assert tables.repeated_keys(spark, 1000, 16).select("key").distinct().count() == 16
    assert tables.wide_rows(tables.unique_keys(spark, 3)).columns == ["key", *[f"v{i}" for i in range(7)]]
    path = str(tmp_path / "x.parquet")
    assert tables.load_checked(spark, path, 5) is None
    made = tables.load_or_generate(spark, path, 20)
    assert made.count() == 20 and tables.load_checked(spark, path, 21) is None and tables.load_checked(spark, path, 20).count() == 20
    runs = Runs()
    with runs.block("q", scale=10, bits=3):
        pass
    out = runs.frame(spark).select("name", "seconds")
    tables.write_results(out, str(tmp_path / "csv"))
    assert tables.read_results(spark, str(tmp_path / "csv"), "name string, seconds double").count() == 1
    assert median_seconds(lambda: None) >= 0


def test_materialized_model_lets_go_of_its_results(spark):
    df = tables.uniform(spark, 500)
    want = sum(r.x for r in df.collect() if r.x not in (11, 42))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert one(relational.total_materialized(df, [("<>", 11), ("<>", 42)])) == want
    assert one(relational.total_materialized(df, [])) == sum(r.x for r in df.collect())
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_models_keep_the_caller_s_settings(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        own = relational.modelled(spark, "tuple")
        assert own.conf.get("spark.sql.shuffle.partitions") == "3" and own.conf.get("spark.sql.codegen.wholeStage") == "false"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 9, [1.0] * 50 + [2.0] * 50, [-1e300, 0.0, 1e300], [float(k * k % 97) for k in range(500)], [1.0, 1.0 + 2**-52] * 30])
def test_median_in_steps(spark, values, monkeypatch):
    from statistics import median

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for kept in (4, 1 << 16):
        monkeypatch.setattr(relational, "SORTED", kept)
        monkeypatch.setattr(relational, "RANGES", 8)
        got = one(relational.median_of(df, "v"))
        assert got is None if not values else got == pytest.approx(median(values), rel=1e-15)


def test_keys_are_a_sample(spark):
    """Distinct keys of a seeded sample leave gaps and clusters as chance does: about 1/e of the stretches have none."""
    got = [r.key for r in tables.unique_keys(spark, 4000, 16).collect()]
    assert len(set(got)) == 4000 and 0 <= min(got) and max(got) < 64_000
    empty = 4000 - len({k // 16 for k in got})
    assert 0.3 * 4000 < empty < 0.45 * 4000


def test_counters_and_sink(spark):
    runs = Runs(spark)
    with runs.block("groups", rows=100):
        spark.range(100).groupBy(F.col("id") % 7).count().write.format("noop").mode("overwrite").save()
    row = runs.frame(spark).first()
    assert row.counters["tasks"] > 0 and row.counters["shuffle_write_bytes"] > 0 and row.counters["cpu_ns"] > 0
    assert [r.total for r in tables.result_sink(spark.range(30), ["id"], 4).collect()] == [30] * 4
    assert tables.result_sink(spark.range(0), ["id"]).count() == 0


def test_kept_tables(spark, monkeypatch):
    import os

    from quarry.sources import kept

    there = kept.written(spark.range(5), "some")
    assert there.count() == 5
    path = kept._paths[spark.sparkContext.applicationId][-1].removeprefix("file://")
    assert os.path.exists(path)
    assert kept.removed(spark) >= 1 and not os.path.exists(path)

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://far:7077", "x"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        kept.shared_dir(Session())
    Context.master = "local[4]"
    assert kept.shared_dir(Session()) == kept.shared_dir(Session())
