"""All queries of the library by name, with the SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dictionary
from quarry.operators import access, joins, keyset, radix, relational
from quarry.sources.tables import operation, operation_log, preview, repeated_keys, result_sink, table, twin_columns, uniform, unique_keys
from quarry.streaming import keyed_set

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- scan, selection, aggregation over x = l_partkey % 100 -------------------------------------------------------

# The constants of the four queries.
NEQ5 = [("<>", v) for v in (11, 42, 99, 30, 77)]
NEQ4 = [("<>", v) for v in (12, 11, 42, 43)]
EQ = [("=", 11)]
#: Thresholds of the conditional counts.
BELOW, SWEEP = 42, (1, 10, 50, 90, 99)


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.scan(table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 100)


_REL = "(SELECT l_partkey % 100 AS x FROM lineitem) AS rel"
_SUM = "SELECT CAST(COALESCE(SUM(x), 0) AS BIGINT) AS s FROM " + _REL
_Q0 = _SUM + " WHERE x <> 11 AND x <> 42 AND x <> 99 AND x <> 30 AND x <> 77"

_query("q0_sum_neq5", _Q0)(lambda s, d: relational.total(relational.select(_x(s, d), NEQ5)))
_query("q1_select_eq", f"SELECT CAST(x AS BIGINT) AS x FROM {_REL} WHERE x = 11")(lambda s, d: relational.select(_x(s, d), EQ))
_query("q2_sum_neq4", _SUM + " WHERE x <> 12 AND x <> 11 AND x <> 42 AND x <> 43")(lambda s, d: relational.total(relational.select(_x(s, d), NEQ4)))
_query("q3_sum_all", _SUM)(lambda s, d: relational.total(_x(s, d)))
_query("select_neq", f"SELECT CAST(x AS BIGINT) AS x FROM {_REL} WHERE x <> 11")(lambda s, d: relational.select(_x(s, d), [("<>", 11)]))
_query("select_smaller", f"SELECT CAST(x AS BIGINT) AS x FROM {_REL} WHERE x < 42")(lambda s, d: relational.select(_x(s, d), [("<", BELOW)]))
_query("scan_project", f"SELECT CAST(x AS BIGINT) AS x FROM {_REL}")(_x)
_query("count_all", f"SELECT COUNT(*) AS n FROM {_REL}")(lambda s, d: relational.count(_x(s, d)))
_query("count_neq5", f"SELECT COUNT(*) AS n FROM {_REL} WHERE x <> 11 AND x <> 42 AND x <> 99 AND x <> 30 AND x <> 77")(lambda s, d: relational.count(relational.select(_x(s, d), NEQ5)))
_query("count_smaller", f"SELECT COUNT(*) AS n FROM {_REL} WHERE x < 42")(lambda s, d: relational.count(relational.select(_x(s, d), [("<", BELOW)])))
_query("sum_smaller", _SUM + " WHERE x < 42")(lambda s, d: relational.total(relational.select(_x(s, d), [("<", BELOW)])))
_query("agg_empty", f"SELECT CAST(COALESCE(SUM(x), 0) AS BIGINT) AS s, COUNT(*) AS n FROM {_REL} WHERE x < 0")(
    lambda s, d: relational.select(_x(s, d), [("<", 0)]).agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("s"), F.count("*").alias("n"))
)
_query("model_volcano", _Q0)(lambda s, d: relational.total(relational.select(_x(relational.modelled(s, "tuple"), d), NEQ5)))
_query("model_vectorized", _Q0)(lambda s, d: relational.total(relational.select(_x(relational.modelled(s, "vector"), d), NEQ5)))
_query("model_materialized", _Q0)(lambda s, d: relational.total_materialized(_x(s, d), NEQ5))
_query("preview_top10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")(lambda s, d: preview(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]))
_query("result_sink", "SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 10")(
    lambda s, d: result_sink(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
)
_query("run_median", "SELECT CAST(MEDIAN(o_totalprice) AS DOUBLE) AS m FROM orders")(lambda s, d: relational.median_of(table(s, d, "orders"), "o_totalprice"))
_query("sorted_keys", "SELECT DISTINCT o_custkey AS key FROM orders ORDER BY key")(lambda s, d: keyset.ordered(joins.keys_of(table(s, d, "orders"), "o_custkey")))

# --- conditional counts ------------------------------------------------------------------------------------------

for _width, _type in (("8", "tinyint"), ("64", "bigint")):
    for _free in (False, True):
        _query(f"count{_width}_{'brfree' if _free else 'branch'}", f"SELECT COUNT(*) AS n FROM lineitem WHERE CAST(l_partkey % 100 AS {_type}) < 42")(
            lambda s, d, t=_type, b=_free: relational.count_below(table(s, d, "lineitem"), (F.col("l_partkey") % 100).cast(t), BELOW, b)
        )
_query("count_simd", "SELECT COUNT(*) FILTER (WHERE l_partkey % 100 < 42) AS n8, COUNT(*) FILTER (WHERE l_partkey % 100 < 42) AS n64 FROM lineitem")(
    lambda s, d: _x(s, d).agg(F.count_if(F.col("x").cast("tinyint") < BELOW).alias("n8"), F.count_if(F.col("x") < BELOW).alias("n64"))
)
_query("selectivity_sweep", "SELECT CAST(sel AS INTEGER) AS sel, COUNT(*) FILTER (WHERE l_partkey % 100 < sel) AS n FROM lineitem, (VALUES (1), (10), (50), (90), (99)) AS t(sel) GROUP BY sel")(
    lambda s, d: relational.count_below_each(table(s, d, "lineitem"), F.col("l_partkey") % 100, SWEEP)
)

_query("selectivity_sweep_chunks", """SELECT CAST(o_orderkey // 4096 AS BIGINT) AS chunk, CAST(sel AS INTEGER) AS sel, COUNT(*) FILTER (WHERE o_custkey % 100 < sel) AS n
FROM orders, (VALUES (1), (10), (50), (90), (99)) AS t(sel) GROUP BY 1, 2""")(lambda s, d: relational.count_below_chunks(table(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 100, SWEEP, 4096))

# --- joins -------------------------------------------------------------------------------------------------------


def _r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keys_of(table(spark, sf_dir, "orders"), "o_custkey")


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keys_of(table(spark, sf_dir, "part"), "p_partkey")


def _s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keys_of(table(spark, sf_dir, "lineitem"), "l_partkey")


_SEMI = "SELECT COUNT(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = l_partkey)"
_query("join_semi", _SEMI)(lambda s, d: joins.semi_count(_r(s, d), _s(s, d)))
_query("join_semi_broadcast", _SEMI)(lambda s, d: joins.semi_count(_r(s, d), _s(s, d), "broadcast"))
_query("join_semi_merge", _SEMI)(lambda s, d: joins.semi_count(_r(s, d), _s(s, d), "merge"))
for _b in (0, 4, 8):
    _query(f"join_semi_radix1_{_b}", _SEMI)(lambda s, d, b=_b: joins.semi_count(_r(s, d), _s(s, d), "radix", (b,)))
for _b in ((1, 2), (3, 3)):
    _query("join_semi_radix2_{}_{}".format(*_b), _SEMI)(lambda s, d, b=_b: joins.semi_count(_r(s, d), _s(s, d), "radix", b))
_query("join_inner_count", "SELECT COUNT(*) AS n FROM lineitem JOIN orders ON o_custkey = l_partkey")(lambda s, d: joins.inner_count(_r(s, d), _s(s, d)))
_query("join_semi_unique_keys", "SELECT COUNT(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = o_custkey)")(lambda s, d: joins.semi_count(_unique(s, d), _r(s, d)))
_query("join_inner_unique_keys", "SELECT COUNT(*) AS n FROM orders JOIN part ON p_partkey = o_custkey")(lambda s, d: joins.inner_count(_unique(s, d), _r(s, d)))
_query("key_intersect", "SELECT l_partkey AS key FROM lineitem INTERSECT SELECT o_custkey FROM orders")(lambda s, d: joins.key_intersection(_r(s, d), _s(s, d)))
_query("build_distinct", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders")(lambda s, d: _r(s, d).agg(F.count_distinct("key").alias("n")))

# --- radix partitioning ------------------------------------------------------------------------------------------

_HIST = "SELECT l_partkey & 15 AS bucket, COUNT(*) AS n FROM lineitem GROUP BY 1"
_query("radix_histogram", _HIST)(lambda s, d: radix.histogram(_s(s, d), 4))
_query("radix_offsets", f"SELECT bucket, n, CAST(COALESCE(SUM(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({_HIST}) AS h")(
    lambda s, d: radix.offsets(radix.histogram(_s(s, d), 4))
)
_query("radix_two_pass_histogram", "SELECT l_partkey & 7 AS b1, (l_partkey >> 3) & 7 AS b2, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")(lambda s, d: radix.histogram2(_s(s, d), 3, 3))
_query("radix_positions", "SELECT o_orderkey, o_custkey & 15 AS bucket, ROW_NUMBER() OVER (ORDER BY o_custkey & 15, o_orderkey) - 1 AS pos FROM orders")(
    lambda s, d: radix.positions(table(s, d, "orders").select("o_orderkey", "o_custkey"), 4, "o_custkey", "o_orderkey", chunk=1 << 12)
)
_query("radix_task_offsets", """SELECT bucket, chunk, n, CAST(COALESCE(SUM(n) OVER (ORDER BY bucket, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT o_custkey & 15 AS bucket, CAST(o_orderkey // 4096 AS BIGINT) AS chunk, COUNT(*) AS n FROM orders GROUP BY 1, 2) AS h""")(
    lambda s, d: radix.task_offsets(table(s, d, "orders"), 4, "o_custkey", "o_orderkey", chunk=1 << 12)
)
_query("radix_placement", "SELECT l_partkey & 15 AS bucket, COUNT(*) AS n, CAST(0 AS BIGINT) AS astray FROM lineitem GROUP BY 1")(lambda s, d: radix.misplaced(_s(s, d), 4))

# --- dictionary decoding -----------------------------------------------------------------------------------------

_LIST = "[100, 101, 102, 103, 200, 201, 202, 203, 300, 301, 302, 303, 400, 401, 402, 403]"
_DECODE = f"""SELECT 2 * event_id AS out_pos, CAST({_LIST}[CAST((event_id % 256) >> 4 AS INTEGER) + 1] AS INTEGER) AS value FROM events
UNION ALL SELECT 2 * event_id + 1, CAST({_LIST}[CAST((event_id % 256) & 15 AS INTEGER) + 1] AS INTEGER) FROM events"""


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") % 256).cast("int").alias("b"))


for _name, _decode in (("scalar", dictionary.decode_scalar), ("table", dictionary.decode_table), ("array", dictionary.decode_array), ("map", dictionary.decode_map)):
    _query(f"dict_decode_{_name}", _DECODE)(lambda s, d, f=_decode: f(_bytes(s, d)))
_query("dict_byte_table", f"SELECT CAST(b AS INTEGER) AS b, CAST({_LIST}[CAST(b >> 4 AS INTEGER) + 1] AS INTEGER) AS first, CAST({_LIST}[CAST(b & 15 AS INTEGER) + 1] AS INTEGER) AS second FROM range(256) AS t(b)")(
    lambda s, d: dictionary.byte_table(s)
)
_query("dict_nibble_table", f"SELECT CAST(code AS INTEGER) AS code, CAST({_LIST}[CAST(code AS INTEGER) + 1] AS INTEGER) AS value FROM range(16) AS t(code)")(lambda s, d: dictionary.nibble_table(s))

# --- access patterns over the cells 0..n-1 (p_partkey) -----------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def _cycle_sql(order: str) -> str:
    return f"SELECT id, COALESCE(LEAD(id) OVER w, FIRST_VALUE(id) OVER w) AS next FROM (SELECT p_partkey AS id, (SELECT COUNT(*) FROM part) AS n FROM part) AS c WINDOW w AS (ORDER BY {order})"


_query("cycle_sequential", _cycle_sql("id"))(lambda s, d: access.strided(_cells(s, d), 1))
_query("cycle_stride", _cycle_sql("id % 7, id // 7"))(lambda s, d: access.strided(_cells(s, d), 7))
_query("cycle_reverse", _cycle_sql("(n - 1 - id) % 7, (n - 1 - id) // 7"))(lambda s, d: access.strided_back(_cells(s, d), 7))
_query("cycle_random", _cycle_sql("md5('42-' || CAST(id AS VARCHAR))"))(lambda s, d: access.shuffled(_cells(s, d)))
_query("cycle_traverse", f"""WITH RECURSIVE c AS MATERIALIZED ({_cycle_sql("md5('42-' || CAST(id AS VARCHAR))")}),
w(id, k) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT c.next, k + 1 FROM w JOIN c USING (id) WHERE k < (SELECT COUNT(*) FROM part))
SELECT (SELECT COUNT(*) FROM c) AS cells, CASE WHEN COUNT(DISTINCT id) = COUNT(*) - 1 AND MAX(k) FILTER (WHERE id = 0) = COUNT(*) - 1 THEN COUNT(*) - 1 ELSE 0 END AS returned,
  (SELECT COUNT(DISTINCT next) FROM c) AS successors FROM w""")(    lambda s, d: access.traversed(access.shuffled(_cells(s, d)), _cells(s, d).count())
)
_query("cell_members", "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT o_custkey FROM orders)")(
    lambda s, d: access.members(table(s, d, "orders").select(F.col("o_custkey").alias("id")), _cells(s, d))
)

# --- seeded generators, by what holds for any seed ---------------------------------------------------------------

_query("gen_uniform", "SELECT CAST(10000 AS BIGINT) AS n, TRUE AS inside, CAST(100 AS BIGINT) AS seen")(
    lambda s, d: uniform(s, 10_000).agg(F.count("*").alias("n"), F.bool_and((F.col("x") >= 0) & (F.col("x") < 100)).alias("inside"), F.count_distinct("x").alias("seen"))
)
_query("gen_unique_keys", "SELECT CAST(4096 AS BIGINT) AS n, CAST(4096 AS BIGINT) AS keys, TRUE AS inside")(
    lambda s, d: unique_keys(s, 4096).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.bool_and((F.col("key") >= 0) & (F.col("key") < 4096 * 16)).alias("inside"))
)
_query("gen_twin_columns", "SELECT CAST(20000 AS BIGINT) AS n, CAST(20000 AS BIGINT) AS alike, CAST(100 AS BIGINT) AS seen")(
    lambda s, d: twin_columns(s, 20_000).agg(F.count("*").alias("n"), F.count_if(F.col("in8").cast("long") == F.col("in64")).alias("alike"), F.count_distinct("in8").alias("seen"))
)
_query("gen_repeated_keys", "SELECT CAST(20000 AS BIGINT) AS n, CAST(64 AS BIGINT) AS keys")(lambda s, d: repeated_keys(s, 20_000, 64).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")))
_query("gen_operation_mix", "SELECT op, CAST(n AS BIGINT) AS n FROM (VALUES ('contains', 600), ('insert', 200), ('remove', 200)) AS t(op, n)")(
    lambda s, d: operation_log(s, 1000).groupBy("op").agg(F.count("*").alias("n"))
)

# --- keyed set over the events: dense keys user_id % 16, sparse keys event_id * 7919 % 4028 ------------------------

DENSE, DENSE_START, SPARSE, SPARSE_START = 16, 12, 4028, 3021


def _log(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    key = F.col("event_id") * 7919 % SPARSE if sparse else F.col("user_id") % DENSE
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), key.cast("long").alias("key"), operation(F.col("event_id")).alias("op"))


def _start(spark: SparkSession, sparse: bool = False) -> DataFrame:
    return spark.range(SPARSE_START if sparse else DENSE_START).select(F.col("id").alias("key"))


_OP = "CASE WHEN event_id % 10 < 6 THEN 'contains' WHEN event_id % 10 < 8 THEN 'insert' ELSE 'remove' END"
for _sparse in (False, True):
    _tag, _key, _from = ("sparse", f"event_id * 7919 % {SPARSE}", SPARSE_START) if _sparse else ("dense", f"user_id % {DENSE}", DENSE_START)
    _ops = f"(SELECT event_id AS i, CAST({_key} AS BIGINT) AS key, {_OP} AS op FROM events) AS ops"
    _base = f"(SELECT range AS key FROM range({_from}))"
    _replay = f"""SELECT i, key, op, present, CASE WHEN op = 'insert' THEN NOT present ELSE present END AS result FROM (
SELECT i, key, op, COALESCE(LAST_VALUE(CASE WHEN op = 'insert' THEN TRUE WHEN op = 'remove' THEN FALSE END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), key < {_from}) AS present FROM {_ops}) AS p"""
    _query(f"set_contains_{_tag}", f"SELECT COUNT(*) AS n FROM {_ops} WHERE key < {_from}")(lambda s, d, x=_sparse: keyset.contains_count(_start(s, x), _log(s, d, x)))
    _query(f"set_insert_{_tag}", f"SELECT key FROM {_base} AS b UNION SELECT key FROM {_ops} WHERE op = 'insert'")(
        lambda s, d, x=_sparse: keyset.insert(_start(s, x), _log(s, d, x).filter("op = 'insert'"))
    )
    # Every dense key is removed at some time, so this set starts with as many keys that no operation names.
    _whole = f"(SELECT range AS key FROM range({_from if _sparse else 2 * DENSE}))"
    _query(f"set_remove_{_tag}", f"SELECT key FROM {_whole} AS b EXCEPT SELECT key FROM {_ops} WHERE op = 'remove'")(
        lambda s, d, x=_sparse: keyset.remove(_start(s, x) if x else s.range(2 * DENSE).select(F.col("id").alias("key")), _log(s, d, x).filter("op = 'remove'"))
    )
    _query(f"set_insert_then_contains_{_tag}", f"SELECT COUNT(*) AS n FROM {_ops} WHERE key < {_from} OR key IN (SELECT key FROM {_ops} WHERE op IN ('contains'))")(
        lambda s, d, x=_sparse: keyset.contains_count(keyset.insert(_start(s, x), _log(s, d, x).filter("op = 'contains'")), _log(s, d, x))
    )
    _query(f"set_remove_then_contains_{_tag}", f"SELECT COUNT(*) AS n FROM {_ops} WHERE key < {_from} AND key NOT IN (SELECT key FROM {_ops} WHERE op = 'remove')")(
        lambda s, d, x=_sparse: keyset.contains_count(keyset.remove(_start(s, x), _log(s, d, x).filter("op = 'remove'")), _log(s, d, x))
    )
    _query(f"set_mixed_replay_{_tag}", _replay)(lambda s, d, x=_sparse: keyset.replay(_log(s, d, x), F.col("key") < (SPARSE_START if x else DENSE_START), block=1 << 12))
    _query(f"set_final_state_{_tag}", f"""SELECT key FROM (SELECT key FROM {_base} AS b UNION SELECT key FROM {_ops}) AS k LEFT JOIN
(SELECT key, arg_max(op, i) = 'insert' AS inside FROM {_ops} WHERE op <> 'contains' GROUP BY key) AS c USING (key) WHERE COALESCE(inside, key < {_from})""")(
        lambda s, d, x=_sparse: keyset.final_state(_log(s, d, x), _start(s, x))
    )
    if not _sparse:
        _query("stream_set_replay", _replay)(
            lambda s, d: keyed_set.run_available(
                s,
                keyed_set.replayed(
                    keyed_set.log_stream(s, f"{d}/events.parque[t]", table(s, d, "events").schema, (F.col("user_id") % DENSE).cast("long"), operation(F.col("event_id"))), DENSE_START
                ),
                "set-replay",
            )
        )
