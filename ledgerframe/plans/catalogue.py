"""Every query of the engine over the test tables, with the DuckDB SQL that gives the same rows.

``events`` is a change log: user_id is the key, event_id the sequence number, event_type 'error' a tombstone. The other tables are
keyed tables. Queries whose order matters return each row's position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import binpack, hashing
from ..functions.expr import Capture, Col, Expr, Lit, columns, compile_predicate, dump, parse
from ..functions.ordering import key_order
from ..operators import history, lookups, state, stats
from ..operators.table import PRESETS, Database, Table
from ..sources.manifest import Conflict
from ..sources.workspace import workspace
from ..streaming.replicate import deduplicated, missing, replicate

Query = Callable[[SparkSession, str], DataFrame]

#: The past that time-travel queries look at.
THEN = 700

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op, "user_id", "event_type", "value")


KEY = ["user_id"]
LOG = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, user_id, event_type, value FROM events)"


def _newest(source: str, where: str = "TRUE", alive: bool = True) -> str:
    """SQL: the newest row of each user in ``source``."""
    return f"SELECT seq, op, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM {source} WHERE {where}) WHERE rn = 1" + (" AND op <> 'D'" if alive else "")


# --- scans, lookups, counts ------------------------------------------------------------------------------------------


@_query("SELECT * FROM customer WHERE c_custkey = 42")
def point_get(spark, d):
    return _table(spark, d, "customer").where(F.col("c_custkey") == 42)


@_query("SELECT count(*) > 0 AS found, (SELECT count(*) > 0 FROM customer WHERE c_custkey = -1) AS absent FROM customer WHERE c_custkey = 42")
def exists_key(spark, d):
    c = _table(spark, d, "customer").select("c_custkey")
    return lookups.any_row(c, F.col("c_custkey") == 42, "found").crossJoin(lookups.any_row(c, F.col("c_custkey") == -1, "absent"))  # one row each


@_query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders")
def scan_all_pos(spark, d):
    return lookups.with_position(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@_query("SELECT *, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer WHERE c_custkey >= 100")
def scan_from(spark, d):
    return lookups.with_position(lookups.in_range(_table(spark, d, "customer"), ["c_custkey"], (100,)), ["c_custkey"])


@_query("SELECT *, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer WHERE c_custkey >= 50 AND c_custkey < 90")
def scan_range(spark, d):
    return lookups.with_position(lookups.in_range(_table(spark, d, "customer"), ["c_custkey"], (50,), (90,)), ["c_custkey"])


@_query("SELECT p_name, p_partkey, row_number() OVER (ORDER BY strlen(p_name), encode(p_name), p_partkey) AS pos FROM part")
def scan_string_pk_order(spark, d):
    return lookups.with_position(_table(spark, d, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"])


@_query("SELECT s_name, s_suppkey FROM supplier WHERE strlen(s_name) = 18 AND encode(s_name) >= encode('Supplier#000000003') AND encode(s_name) < encode('Supplier#000000008')")
def scan_string_range(spark, d):
    return lookups.in_range(_table(spark, d, "supplier").select("s_name", "s_suppkey"), ["s_name"], ("Supplier#000000003",), ("Supplier#000000008",))


@_query("SELECT c_custkey - 70 AS k, row_number() OVER (ORDER BY c_custkey < 70, c_custkey) AS pos FROM customer")
def scan_signed_pk_order(spark, d):
    return lookups.with_position(_table(spark, d, "customer").select((F.col("c_custkey") - 70).alias("k")), ["k"])


@_query("SELECT k FROM (SELECT c_custkey - 70 AS k FROM customer) WHERE k >= 5 OR k < -20")
def scan_signed_range(spark, d):
    keys = _table(spark, d, "customer").select((F.col("c_custkey") - 70).alias("k"))
    return lookups.in_range(keys, ["k"], (5,), (-20,))


@_query("SELECT c_acctbal, c_custkey, row_number() OVER (ORDER BY c_acctbal < 0, abs(c_acctbal), c_custkey) AS pos FROM customer")
def scan_double_pk_order(spark, d):
    return lookups.with_position(_table(spark, d, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"])


@_query("SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations")
def scan_composite_pk(spark, d):
    return lookups.with_position(_table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


@_query("SELECT encode(c_name) AS key, encode(c_mktsegment) AS value FROM customer WHERE encode(c_name) >= encode('Customer#000000010') AND encode(c_name) < encode('Customer#000000020')")
def raw_range_scan(spark, d):
    raw = _table(spark, d, "customer").select(F.encode("c_name", "UTF-8").alias("key"), F.encode("c_mktsegment", "UTF-8").alias("value"))
    return raw.where((F.col("key") >= F.lit(b"Customer#000000010")) & (F.col("key") < F.lit(b"Customer#000000020")))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def filter_one(spark, d):
    return _table(spark, d, "orders").where(F.col("o_totalprice") > 200000).select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def filter_two(spark, d):
    return _table(spark, d, "orders").where(F.col("o_totalprice") > 100000).where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10")
def filter_limit(spark, d):
    rows = _table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")
    return lookups.first_rows(rows, ["o_orderkey"], 10)


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 ORDER BY o_orderkey LIMIT 1")
def filter_first(spark, d):
    rows = _table(spark, d, "orders").where(F.col("o_totalprice") > 150000).select("o_orderkey", "o_totalprice")
    return lookups.first_rows(rows, ["o_orderkey"], 1)


@_query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 1e12")
def filter_any(spark, d):
    return lookups.any_row(_table(spark, d, "orders"), F.col("o_totalprice") > 1e12, "found")


@_query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_count(spark, d):
    return _table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS n FROM lineitem")
def table_count(spark, d):
    return _table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS n FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def range_count(spark, d):
    return lookups.in_range(_table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], (100,), (900,)).agg(F.count("*").alias("n"))


@_query("SELECT c.c_custkey, c.c_name, c.c_acctbal FROM customer c JOIN (SELECT DISTINCT o_custkey FROM orders) p ON p.o_custkey = c.c_custkey")
def batched_point_lookup_all(spark, d):
    probes = _table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.lookup(_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], probes)


@_query("SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def positive_gets(spark, d):
    probes = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return lookups.lookup_each(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], probes)


@_query("SELECT count(*) AS probes, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS found FROM lineitem")
def positive_exists(spark, d):
    return lookups.count_found(_table(spark, d, "orders"), ["o_orderkey"], _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")))


@_query("SELECT count(*) AS probes, 0 AS found FROM lineitem")
def negative_exists(spark, d):
    return lookups.count_found(_table(spark, d, "orders"), ["o_orderkey"], _table(spark, d, "lineitem").select((-1 - F.col("l_orderkey")).alias("o_orderkey")))


@_query("SELECT * FROM customer WHERE c_name = 'Customer#000000042'")
def find_by_unique(spark, d):
    rows = _table(spark, d, "customer")
    return lookups.find_by(rows.withColumn("seq", F.col("c_custkey")), "c_name", "Customer#000000042").drop("seq")


@_query("SELECT c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment")
def find_by_last_wins(spark, d):
    return lookups.unique_index(_table(spark, d, "customer").withColumn("seq", F.col("c_custkey")), "c_mktsegment", ["c_custkey"])


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7")
def find_all_by(spark, d):
    return lookups.find_all_by(_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", 7)


# --- state, history ---------------------------------------------------------------------------------------------------


@_query(f"WITH {LOG} {_newest('log')}")
def current_state(spark, d):
    return state.current(_log(spark, d), KEY)


@_query(f"WITH {LOG} {_newest('log', f'seq <= {THEN}')}")
def as_of_state(spark, d):
    return state.as_of(_log(spark, d), KEY, THEN)


@_query(f"WITH {LOG} {_newest('log', alive=False)}")
def tombstones_kept(spark, d):
    return state.latest(_log(spark, d), KEY)


@_query(f"WITH {LOG} {_newest('log', f'seq <= {THEN} AND user_id IN (3, 5, 8)')}")
def get_at(spark, d):
    return history.get_at(_log(spark, d), KEY, F.col("user_id").isin(3, 5, 8), THEN)


@_query(f"WITH {LOG} SELECT *, row_number() OVER (ORDER BY seq) AS version FROM log WHERE user_id = 3")
def history_key(spark, d):
    from ..functions.numbering import numbered

    return numbered(history.history(_log(spark, d), F.col("user_id") == 3), [F.col("seq")], "version")


_TARGETS = f"""targets AS (SELECT a.user_id, coalesce(b.op, 'D') AS op, CASE WHEN b.op = 'P' THEN b.event_type END AS event_type, CASE WHEN b.op = 'P' THEN b.value END AS value
FROM (SELECT user_id FROM log GROUP BY user_id HAVING max(seq) > {THEN}) a LEFT JOIN ({_newest('log', f'seq <= {THEN}', False)}) b USING (user_id))"""


@_query(f"WITH {LOG}, {_TARGETS} SELECT * FROM targets")
def rollback_targets(spark, d):
    return history.rollback_targets(_log(spark, d), KEY, THEN)


_ROLLED = f"""rolled AS (SELECT (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY user_id) AS seq, op, user_id, event_type, value FROM targets),
after AS (SELECT * FROM log UNION ALL SELECT * FROM rolled)"""


@_query(f"WITH {LOG}, {_TARGETS}, {_ROLLED} {_newest('after')}")
def rollback_to_state(spark, d):
    log = _log(spark, d)
    rows = history.rollback_rows(log, KEY, THEN, key_order(log.schema, KEY))
    return state.current(log.unionByName(rows.select(*log.columns)), KEY)


@_query(f"""WITH {LOG}, one AS (SELECT (SELECT max(seq) FROM log) + 1 AS seq, coalesce(max(op), 'D') AS op, 3 AS user_id, max(event_type) AS event_type, max(value) AS value FROM ({_newest('log', f'seq <= {THEN} AND user_id = 3')})),
after AS (SELECT * FROM log UNION ALL SELECT * FROM one) {_newest('after')}""")
def rollback_key_state(spark, d):
    log = _log(spark, d)
    rows = history.rollback_rows(log, KEY, THEN, key_order(log.schema, KEY), F.col("user_id") == 3)
    return state.current(log.unionByName(rows.select(*log.columns)), KEY)


@_query(f"WITH {LOG} SELECT * FROM log WHERE seq >= {THEN} OR seq IN (SELECT max(seq) FROM log WHERE seq < {THEN} GROUP BY user_id)")
def prune_before(spark, d):
    return history.prune_before(_log(spark, d), KEY, THEN)


@_query(f"WITH {LOG} SELECT * FROM log WHERE seq >= {THEN}")
def prune_before_all(spark, d):
    return history.prune_before(_log(spark, d), KEY, THEN, keep_newest=False)


@_query(f"SELECT count(*) AS removed FROM events WHERE event_id < {THEN}")
def prune_removed_count(spark, d):
    return _log(spark, d).where(F.col("seq") < THEN).agg(F.count("*").alias("removed"))


@_query(f"""WITH {LOG}, old AS ({_newest('log', f'seq <= {THEN}', False)}), new AS ({_newest('log', f'seq > {THEN}', False)})
SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def overlay_merge(spark, d):
    log = _log(spark, d)
    return state.overlay(state.latest(log.where(F.col("seq") <= THEN), KEY), state.latest(log.where(F.col("seq") > THEN), KEY), KEY)


@_query(f"WITH {LOG} {_newest('log')}")
def compact_base_delta(spark, d):
    log = _log(spark, d)
    base = state.compact([log.where(F.col("seq") <= THEN)], KEY, bottom=True)
    return state.compacted_state(base, log.where(F.col("seq") > THEN), KEY)


@_query(f"WITH {LOG} {_newest('log', alive=False)}")
def compact_upper_level(spark, d):
    log = _log(spark, d)
    runs = [log.where(F.col("seq") % 3 == i) for i in range(3)]
    return state.compact(runs, KEY, bottom=False)


@_query(f"""WITH {LOG}, probes AS (SELECT o_orderkey AS probe_id, o_custkey AS user_id, o_orderkey % 1000 AS t FROM orders)
SELECT probe_id, p.user_id, t, l.seq, l.op, l.event_type, l.value FROM probes p ASOF LEFT JOIN log l ON p.user_id = l.user_id AND p.t >= l.seq""")
def probe_asof_join_all(spark, d):
    probes = _table(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 1000).alias("t"))
    return history.probe_as_of(_log(spark, d), KEY, probes, "t", "probe_id")


# --- writes -----------------------------------------------------------------------------------------------------------


def _append(log: DataFrame, rows: DataFrame) -> DataFrame:
    from ..functions.numbering import numbered

    last = log.agg(F.max("seq").alias("seq")).first()["seq"]
    return log.unionByName(numbered(rows, key_order(rows.schema, KEY), "seq", last + 1).select(*log.columns))


_NEXT = "(SELECT max(seq) FROM log) + row_number() OVER (ORDER BY user_id) AS seq"


@_query(f"WITH {LOG}, puts AS (SELECT {_NEXT}, 'P' AS op, user_id, c_mktsegment AS event_type, c_acctbal AS value FROM (SELECT *, c_custkey AS user_id FROM customer)), after AS (SELECT * FROM log UNION ALL SELECT * FROM puts) {_newest('after')}")
def put_batch_all(spark, d):
    rows = _table(spark, d, "customer").select(F.lit("P").alias("op"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_acctbal").alias("value"))
    return state.current(_append(_log(spark, d), rows), KEY)


@_query(f"WITH {LOG}, gone AS (SELECT {_NEXT}, 'D' AS op, user_id, NULL AS event_type, NULL AS value FROM (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 4 = 0)), after AS (SELECT * FROM log UNION ALL SELECT * FROM gone) {_newest('after')}")
def remove_batch(spark, d):
    rows = _table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.lit("D").alias("op"), F.col("c_custkey").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    return state.current(_append(_log(spark, d), rows), KEY)


@_query(f"""WITH {LOG}, cur AS ({_newest('log')}), ups AS (SELECT {_NEXT}, 'P' AS op, user_id, event_type, coalesce(value, 0) + 1 AS value FROM (SELECT c_custkey AS user_id FROM customer) LEFT JOIN cur USING (user_id)),
after AS (SELECT * FROM log UNION ALL SELECT seq, op, user_id, event_type, value FROM ups) {_newest('after')}""")
def upsert_batch_all(spark, d):
    log = _log(spark, d)
    probes = _table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    rows = lookups.upsert_rows(state.current(log, KEY), KEY, probes, {"value": F.coalesce("value", F.lit(0.0)) + 1})
    return state.current(_append(log, rows.withColumn("op", F.lit("P"))), KEY)


@_query("SELECT doc_id, CASE WHEN strlen(text) < 16384 THEN text END AS text, CASE WHEN strlen(text) >= 16384 THEN doc_id END AS blob_id, CASE WHEN strlen(text) >= 16384 THEN strlen(text) END AS bytes FROM documents")
def blob_split(spark, d):
    inline, _ = lookups.split_blobs(_table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return inline.select("doc_id", "text", F.col("text_blob.blob_id").alias("blob_id"), F.col("text_blob.bytes").alias("bytes"))


@_query("SELECT page_id, html FROM pages")
def blob_deref(spark, d):
    inline, blobs = lookups.split_blobs(_table(spark, d, "pages").select("page_id", "html"), "html", "page_id")
    return lookups.join_blobs(inline, blobs, "html")


@_query("SELECT doc_id AS blob_id, strlen(text) AS bytes FROM documents WHERE strlen(text) >= 16384 AND doc_id % 2 = 1")
def blob_orphans(spark, d):
    inline, blobs = lookups.split_blobs(_table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    found = lookups.blob_orphans(blobs, inline.where("doc_id % 2 = 0"), "text")
    return found.select("blob_id", F.octet_length("value").cast("long").alias("bytes"))


# --- predicates -------------------------------------------------------------------------------------------------------

#: Rows with every kind of value, some null, some NaN, some beyond 2**53.
_ENTITY = """e AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS flag, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 10 END AS opt, 9007199254740992 + c_custkey % 4 AS big,
CASE WHEN c_custkey % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal END AS d, c_mktsegment AS s, CASE WHEN c_custkey % 5 > 0 THEN [c_mktsegment, NULL] END AS tags,
CASE WHEN c_custkey % 6 > 0 THEN map {c_mktsegment: c_custkey} END AS scores, {'city': c_mktsegment, 'zip': c_name} AS address FROM customer)"""


def _entity(spark: SparkSession, d: str) -> DataFrame:
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    return _table(spark, d, "customer").select(
        k.alias("id"), (k % 2 == 0).alias("flag"), F.when(k % 3 > 0, k % 10).alias("opt"), (F.lit(2**53) + k % 4).alias("big"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("d"), seg.alias("s"), F.when(k % 5 > 0, F.array(seg, F.lit(None).cast("string"))).alias("tags"),
        F.when(k % 6 > 0, F.create_map(seg, k)).alias("scores"), F.struct(seg.alias("city"), F.col("c_name").alias("zip")).alias("address"),
    )


def _predicate(name: str, expr: Expr, where: str, captures: tuple = (), **options: bool) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _entity(spark, d)
        return rows.where(compile_predicate(expr, rows.schema, captures, **options)).select("id")

    run.__name__ = name
    _query(f"WITH {_ENTITY} SELECT id FROM e WHERE {where}")(run)


c = Col
_predicate("expr_eq_null", c("opt") == Lit(None), "opt IS NULL")
_predicate("expr_eq_value", c("opt") == 4, "opt = 4")
_predicate("expr_neq_null", c("opt") != 4, "opt IS DISTINCT FROM 4")
_predicate("expr_int_double", (c("opt") == 4.0) | (c("id") == 9), "id = 9")
_predicate("expr_nan", c("d") == c("d"), "NOT isnan(d)")
_predicate("expr_nan_order", (c("d") > 0.0) | (c("d") <= 0.0), "NOT isnan(d)")
_predicate("expr_cmp_double_cast", c("big") > 2**53, "CAST(big AS DOUBLE) > 9007199254740992.0")
_predicate("expr_cmp_exact_ints", c("big") > 2**53, "big > 9007199254740992", exact_ints=True)
_predicate("expr_cmp_null_lenient", c("opt") > 3, "coalesce(opt > 3, FALSE)")
_predicate("expr_string_cmp", (c("s") >= "B") & (c("s") < "H"), "s >= 'B' AND s < 'H'")
_predicate("expr_and_or", ((c("opt") == 1) & c("flag")) | (c("s") == "BUILDING") & ~c("flag"), "(coalesce(opt = 1, FALSE) AND flag) OR (s = 'BUILDING' AND NOT flag)")
_predicate("expr_and_non_bool", (c("opt") & c("flag")) | (c("id") == 3), "id = 3")
_predicate("expr_short_circuit", c("opt").is_null() | (c("opt") > 5), "opt IS NULL OR opt > 5")
_predicate("expr_not", ~(c("s") == "BUILDING"), "s <> 'BUILDING'")
_predicate("expr_not_error", ~(c("opt") > 3), "opt <= 3")
_predicate("expr_in_list", Lit("BUILDING").is_in(c("tags")), "coalesce(list_contains(tags, 'BUILDING'), FALSE)")
_predicate("expr_in_list_null", Lit(None).is_in(c("tags")), "tags IS NOT NULL")
_predicate("expr_not_in_null", Lit("BUILDING").not_in(c("tags")), "NOT coalesce(list_contains(tags, 'BUILDING'), FALSE)")
_predicate("expr_in_map", Lit("MACHINERY").is_in(c("scores")), "scores IS NOT NULL AND s = 'MACHINERY'")
_predicate("expr_map_get", c("scores").get("MACHINERY") > 50, "scores IS NOT NULL AND s = 'MACHINERY' AND id > 50")
_predicate("expr_map_get_missing", c("scores").get("none").is_null() & (c("id") < 50), "id < 50")
_predicate("expr_is_null", c("opt").is_null() & c("d").is_not_null(), "opt IS NULL AND d IS NOT NULL")
_predicate("expr_nested_path", c("address.city") == "AUTOMOBILE", "address.city = 'AUTOMOBILE'")
_predicate("expr_missing_column", c("address").is_null() & c("none").is_null() & (c("id") <= 10), "id <= 10")
_predicate("expr_capture", (c("id") >= Capture(0)) & (c("s") == Capture(1)), "id >= 40 AND s = 'FURNITURE'", (40, "FURNITURE"))
_predicate("expr_strict", (c("id") > 10) & (c("id") < 20), "id > 10 AND id < 20", strict=True)
del c


# --- replication, statistics, codec, whole tables --------------------------------------------------------------------


@_query(f"WITH {LOG} {_newest('log')}")
def replica_replay(spark, d):
    return state.current(missing(_log(spark, d), -1), KEY)


@_query(f"WITH {LOG} SELECT * FROM log WHERE seq > {THEN}")
def replica_resume(spark, d):
    return missing(_log(spark, d), THEN)


@_query(f"WITH {LOG} SELECT * FROM log")
def replica_dedup(spark, d):
    log = _log(spark, d)
    return deduplicated(log.unionByName(log.where(F.col("seq") % 3 == 0)))


@_query(f"WITH {LOG} SELECT count(*) AS writes, count(*) FILTER (op = 'P') AS puts, count(*) FILTER (op = 'D') AS deletes, max(seq) AS last_seq, (SELECT count(*) FROM n) AS keys, (SELECT count(*) FROM n WHERE op <> 'D') AS live_keys, (SELECT count(*) FROM n WHERE op = 'D') AS tombstones FROM log".replace("SELECT count(*) AS writes", f", n AS ({_newest('log', alive=False)}) SELECT count(*) AS writes", 1))
def log_stats(spark, d):
    return stats.log_stats(_log(spark, d), KEY)


@_query(f"SELECT CASE WHEN event_id <= {THEN} THEN 1 ELSE 0 END AS level, count(*) AS rows, min(event_id) AS min_seq, max(event_id) AS max_seq FROM events GROUP BY 1")
def level_stats(spark, d):
    rows = _log(spark, d).withColumn("level", F.when(F.col("seq") <= THEN, 1).otherwise(0))
    files = rows.groupBy("level").agg(F.count("*").alias("rows"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.lit(0).cast("long").alias("bytes"))
    return stats.level_stats(files).select("level", "rows", "min_seq", "max_seq")


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def binpack_roundtrip(spark, d):
    rows = _table(spark, d, "customer")
    kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    packed = rows.select(binpack.encoded(F.struct(*rows.columns), kind).alias("packed"))
    return packed.select(binpack.decoded(F.col("packed"), kind).alias("r")).select("r.*")


@_query("SELECT page_id, replace(url, '/', ' ') AS decoded FROM pages WHERE url NOT LIKE '%\\%%' ESCAPE '\\' AND url NOT LIKE '%+%'")
def percent_decoding(spark, d):
    return _table(spark, d, "pages").select("page_id", hashing.percent_decode(F.regexp_replace("url", "/", "%20")).alias("decoded"))


@_query("SELECT page_id, url_decode(replace(url, '+', ' ')) || '?q=a b c%zz%4' AS decoded FROM pages")
def percent_escapes(spark, d):
    """Every url with escaped slashes, escapes and plus signs of its own behind it, and percent signs that begin no escape."""
    return _table(spark, d, "pages").select("page_id", hashing.percent_decode(F.concat(F.regexp_replace("url", "/", "%2F"), F.lit("?q=a%20b+c%zz%4"))).alias("decoded"))


@_query("WITH f AS (SELECT o_orderkey // 100 AS file, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1) SELECT file FROM f WHERE last >= 300 AND first < 900")
def file_pruning_all(spark, d):
    orders = _table(spark, d, "orders").withColumn("file", F.floor(F.col("o_orderkey") / 100))
    files = orders.groupBy("file").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    return files.where(hashing.ranges_overlap(F.col("first"), F.col("last"), 300, 900)).select("file")


_SEGMENTS = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0"


@_query("SELECT count(*) AS last_seq, 'lineitem' AS written FROM lineitem")
def bulk_put(spark, d):
    """One write of every line item; the last sequence number is their number."""
    rows = _table(spark, d, "lineitem")
    t = Database(spark, workspace(spark, "database")).table("lineitem", rows.schema, ["l_orderkey", "l_linenumber"])
    return _answer(spark, [(t.put(rows), t.name)], "last_seq long, written string")


@_query("SELECT l_orderkey, l_linenumber, max(rn) AS seq FROM (SELECT l_orderkey, l_linenumber, row_number() OVER () AS rn FROM lineitem) GROUP BY ALL")
def bulk_put_newest(spark, d):
    """The newest write of every key after one write of all line items, whose keys repeat: the last in their order."""
    rows = _table(spark, d, "lineitem")
    t = Database(spark, workspace(spark, "database")).table("lineitem", rows.schema, ["l_orderkey", "l_linenumber"])
    t.put(rows)
    return state.current(t.changes.read(), t.key).select("l_orderkey", "l_linenumber", "seq")


@_query(_SEGMENTS)
def table_lifecycle(spark, d):
    """A table on storage: put, change, remove, compact, read."""
    rows = _table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    t = Database(spark, workspace(spark, "database")).table("customer", rows.schema, "c_custkey")
    t.put(rows)
    t.put(rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("changed")))
    t.remove(rows.where("c_custkey % 5 = 0"))
    t.compact()
    return t.rows()


@_query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def table_rollback(spark, d):
    """A table on storage: put, change, roll back, read."""
    rows = _table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    t = Database(spark, workspace(spark, "database")).table("customer", rows.schema, "c_custkey")
    then = t.put(rows)
    t.put(rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("changed")))
    t.remove(rows.where("c_custkey % 5 = 0"))
    t.rollback_to(then)
    return t.rows()


@_query(_SEGMENTS)
def replica_stream(spark, d):
    """A primary's batches streamed to a replica."""
    rows = _table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    root = workspace(spark, "replication")
    primary, replica = (Database(spark, f"{root}/{x}").table("customer", rows.schema, "c_custkey") for x in ("primary", "replica"))
    primary.put(rows)
    primary.put(rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("changed")))
    primary.remove(rows.where("c_custkey % 5 = 0"))
    replicate(spark, primary.changes, replica.changes, f"{root}/checkpoint", 4).awaitTermination()
    return replica.rows()


# --- tables on storage ------------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, d: str, name: str, key: str, preset: str | None = None, **options: object) -> Table:
    """A driver's table as the first batch of a table on storage."""
    rows = _table(spark, d, name)
    t = Database(spark, workspace(spark, "database"), preset, **options).table(name, rows.schema, key)
    t.put(rows)
    return t


def _answer(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """What an interface of the driver program gives, as rows: for tables of a few rows, or counts."""
    return spark.createDataFrame(rows, schema)


_NATION = "n_nationkey, n_name, n_regionkey"


@_query(f"SELECT {_NATION}, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation")
def typed_iterator(spark, d):
    """A row at a time, in key order."""
    t = _stored(spark, d, "nation", "n_nationkey")
    return _answer(spark, [(*r, i) for i, r in enumerate(t.query(), 1)], T.StructType([*t.schema.fields, T.StructField("pos", T.LongType())]))


@_query(f"SELECT {_NATION} FROM nation WHERE n_regionkey = 1 OR n_name >= 'U'")
def cursor_with_predicate(spark, d):
    t = _stored(spark, d, "nation", "n_nationkey")
    return _answer(spark, list(t.query((Col("n_regionkey") == 1) | (Col("n_name") >= "U"))), t.schema)


@_query(f"SELECT {_NATION} FROM nation")
def bulk_scan(spark, d):
    t = _stored(spark, d, "nation", "n_nationkey")
    return _answer(spark, t.query().to_list(), t.schema)


@_query(f"SELECT {_NATION} FROM nation WHERE n_name LIKE 'A%'")
def row_predicate(spark, d):
    """A Python function of a row: slow, nothing is pushed down."""
    return _stored(spark, d, "nation", "n_nationkey").query(lambda r: r.n_name.startswith("A")).df()


@_query(f"SELECT {_NATION}, n_nationkey IN (3, 7) AS there FROM nation WHERE n_nationkey IN (3, 7)")
def typed_get(spark, d):
    t = _stored(spark, d, "nation", "n_nationkey")
    return _answer(spark, [(*t.get(k), t.exists(k)) for k in (3, 7, 99) if t.get(k) or t.exists(k)], T.StructType([*t.schema.fields, T.StructField("there", T.BooleanType())]))


@_query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer WHERE c_custkey >= 10 AND c_custkey < 1000 AND c_custkey % 3 <> 0")
def keys_only_cursor(spark, d):
    t = _stored(spark, d, "customer", "c_custkey")
    t.remove(_table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey"))
    return lookups.with_position(t.keys(10, 1000), ["c_custkey"])


def _levels(spark: SparkSession, d: str, **options: object) -> Table:
    """Customers over several batches and levels: all, every second changed, every fifth removed."""
    t = _stored(spark, d, "customer", "c_custkey", **options)
    rows = _table(spark, d, "customer")
    t.put(rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("changed")))
    t.remove(rows.where("c_custkey % 5 = 0").select("c_custkey"))
    return t


_CHANGED = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 0"


@_query(_CHANGED)
def level_compaction(spark, d):
    """Two batches start a compaction of level 0, and level 1 may hold one byte: rows move down level by level."""
    t = _levels(spark, d, max_l0=2, level_bytes=1)
    t.put(t.rows().where("c_custkey % 3 = 0"))
    return t.rows()


@_query("SELECT 1 AS level, count(*) AS rows, 1 AS min_seq, count(*) AS max_seq FROM customer UNION ALL SELECT 0, count(*), (SELECT count(*) FROM customer) + 1, (SELECT count(*) FROM customer) + count(*) FROM customer WHERE c_custkey % 2 = 0")
def stored_level_stats(spark, d):
    """The tiers as the manifest has them: a base, and a batch since."""
    t = _stored(spark, d, "customer", "c_custkey")
    t.compact()
    t.put(_table(spark, d, "customer").where("c_custkey % 2 = 0"))
    return t.level_stats().select("level", "rows", "min_seq", "max_seq")


@_query("SELECT 4 AS files, count(*) AS rows FROM customer")
def output_splitting(spark, d):
    t = _stored(spark, d, "customer", "c_custkey")
    t.compact(files=4)
    return t.changes.files().select("files", "rows")


_PARTS = ("c_custkey < 50", "c_custkey >= 50 and c_custkey < 100", "c_custkey >= 100")


def _ranges(spark: SparkSession, d: str) -> Table:
    """Customers in three batches of neighbouring keys."""
    rows = _table(spark, d, "customer")
    t = Database(spark, workspace(spark, "database")).table("customer", rows.schema, "c_custkey")
    for part in _PARTS:
        t.put(rows.where(part))
    return t


@_query("SELECT *, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer WHERE c_custkey >= 60 AND c_custkey < 120")
def scan_of_few_batches(spark, d):
    return lookups.with_position(_ranges(spark, d).scan(60, 120), ["c_custkey"])


@_query("SELECT range_start, rows FROM (SELECT 1 AS part, 50 AS range_start, count(*) AS rows FROM customer WHERE c_custkey >= 50 AND c_custkey < 100 UNION ALL SELECT 2, 100, count(*) FROM customer WHERE c_custkey >= 100)")
def batches_opened(spark, d):
    """The batches that a scan of keys 60 to 119 opens: two of three."""
    t = _ranges(spark, d)
    opened = t.changes.overlapping(t.changes.manifest.current().batches, start=(60,), end=(120,))
    return _answer(spark, [(b.first[0], b.rows) for b in opened], "range_start int, rows long")


_LARGE = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html || html ELSE html END AS html FROM pages WHERE page_id % 5 <> 0"


def _pages(spark: SparkSession, d: str) -> Table:
    """Pages whose html of a thousand bytes or more is kept apart: all, every second changed, every fifth removed."""
    rows = _table(spark, d, "pages").select("page_id", "html")
    t = Database(spark, workspace(spark, "database"), blob_bytes=1000).table("pages", rows.schema, "page_id")
    t.put(rows)
    t.put(rows.where("page_id % 2 = 0").withColumn("html", F.concat("html", "html")))
    t.remove(rows.where("page_id % 5 = 0").select("page_id"))
    return t


@_query(_LARGE)
def large_values_of_a_table(spark, d):
    return _pages(spark, d).rows()


@_query(f"SELECT 'now' AS what, * FROM ({_LARGE}) UNION ALL SELECT 'before', page_id, html FROM pages UNION ALL SELECT 'rolled back', page_id, html FROM pages")
def large_values_through_time(spark, d):
    """Large values after a compaction, in the past, and after a rollback."""
    t = _pages(spark, d)
    then = _table(spark, d, "pages").count()
    t.compact()
    t.changes.manifest.vacuum()
    read = lambda what, rows: rows.select(F.lit(what).alias("what"), "page_id", "html")
    now, before = read("now", t.rows()), read("before", t.as_of(then))
    t.rollback_to(then)
    return now.unionByName(before).unionByName(read("rolled back", t.rows()))


@_query("SELECT count(*) FILTER (strlen(html) >= 1000) AS apart, 0 AS in_the_log FROM pages")
def large_values_apart(spark, d):
    """No value of a thousand bytes or more is in the log's own files."""
    rows = _table(spark, d, "pages").select("page_id", "html")
    t = Database(spark, workspace(spark, "database"), blob_bytes=1000).table("pages", rows.schema, "page_id")
    t.put(rows)
    return t.changes.read().agg(F.count_if(F.array_contains("large", "html")).alias("apart"), F.count_if(F.octet_length("html") >= 1000).alias("in_the_log"))


_KEPT = "SELECT c_custkey, c_mktsegment FROM customer"


@_query(f"SELECT 'before' AS what, * FROM ({_KEPT}) UNION ALL SELECT 'now', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'rolled back', * FROM ({_KEPT}) UNION ALL SELECT 'history of 10', 10, v FROM (SELECT unnest([c_mktsegment, 'changed', NULL]) AS v FROM customer WHERE c_custkey = 10)")
def compact_keeps_history(spark, d):
    """Put, change, remove, compact: the state of before, the state of now, a key's history; and a rollback after it."""
    t = _levels(spark, d)
    then = _table(spark, d, "customer").count()
    t.compact()
    read = lambda what, rows: rows.select(F.lit(what).alias("what"), "c_custkey", "c_mktsegment")
    before, now, versions = read("before", t.as_of(then)), read("now", t.rows()), read("history of 10", t.history(10))
    t.rollback_to(then)
    return before.unionByName(now).unionByName(versions).unionByName(read("rolled back", t.rows()))


@_query("SELECT row_number() OVER () AS version, v AS c_mktsegment FROM (SELECT unnest([c_mktsegment, 'changed', NULL]) AS v FROM customer WHERE c_custkey = 10)")
def reopened_history(spark, d):
    """A key's versions from the log after a restart."""
    t = _levels(spark, d)
    t.database.close()
    again = Database(spark, t.database.path).table("customer")
    versions = again.history(10).select("seq", "c_mktsegment").collect()  # of one key
    return _answer(spark, [(i, r["c_mktsegment"]) for i, r in enumerate(versions, 1)], "version long, c_mktsegment string")


@_query(_CHANGED)
def flush_close_reopen(spark, d):
    t = _levels(spark, d)
    t.database.force_sync()
    t.database.force_flush()
    t.database.close()
    return Database(spark, t.database.path).table("customer").rows()


@_query("SELECT unnest(['get', 'put', 'remove', 'exists', 'count', 'scan', 'history', 'table']) AS call, TRUE AS refused")
def calls_after_close(spark, d):
    t = _stored(spark, d, "region", "r_regionkey")
    t.database.close()
    calls = {"get": lambda: t.get(1), "put": lambda: t.put([(9, "x")]), "remove": lambda: t.remove([1]), "exists": lambda: t.exists(1), "count": t.count, "scan": t.scan, "history": lambda: t.history(1), "table": lambda: t.database.table("region")}

    def refused(call: Callable) -> bool:
        try:
            call()
        except RuntimeError:
            return True
        return False

    return _answer(spark, [(name, refused(call)) for name, call in calls.items()], "call string, refused boolean")


@_query("SELECT * FROM customer WHERE c_name = 'Customer#000000007'")
def stored_index(spark, d):
    """An index that is registered after the rows are there, and known after a restart."""
    t = _stored(spark, d, "customer", "c_custkey").index("c_name")
    again = Database(spark, t.database.path).table("customer")
    return _answer(spark, [again.find_by("c_name", "Customer#000000007")], again.schema)


@_query("SELECT 'lost commit' AS what, 0 AS orphans UNION ALL SELECT 'crash', 1 UNION ALL SELECT 'vacuum', 0")
def live_file_orphans(spark, d):
    """Batches that no version names: none after a commit that another writer won, one after a crash before the commit, none after a vacuum."""
    t = _stored(spark, d, "nation", "n_nationkey")
    log, manifest = t.changes, t.changes.manifest
    stale = manifest.current()
    t.put([(99, "X", 1)])
    try:
        log.commit(stale, [log._write(log.read(), 0)])
    except Conflict:
        lost = len(manifest.orphans())
    log._write(log.read(), 0)
    crash = len(manifest.orphans())
    manifest.vacuum()
    return _answer(spark, [("lost commit", lost), ("crash", crash), ("vacuum", len(manifest.orphans()))], "what string, orphans int")


@_query("SELECT unnest(['same node', 'log has node', 'tables differ']) AS what, TRUE AS holds")
def node_identity(spark, d):
    t = _stored(spark, d, "region", "r_regionkey")
    again = Database(spark, t.database.path)
    nodes = {r["node_id"] for r in t.log().select("node_id").distinct().collect()}  # one
    return _answer(spark, [("same node", again.node_id == t.database.node_id), ("log has node", nodes == {again.node_id}), ("tables differ", hashing.fnv1a_64("region") != hashing.fnv1a_64("nation"))], "what string, holds boolean")


@_query("SELECT * FROM (VALUES ('ULTRA_FAST', FALSE, 1000000, 4), ('FAST', FALSE, 1000000, 4), ('NORMAL', TRUE, 1000000, 10), ('DURABLE', TRUE, NULL, 10)) t(preset, history, keep_seqs, writes)")
def presets_and_history(spark, d):
    """What each preset keeps of ten writes (five regions, four of them again, one deletion) after a compaction."""
    rows = []
    for preset in PRESETS:
        t = _stored(spark, d, "region", "r_regionkey", preset)
        t.put(_table(spark, d, "region").where("r_regionkey > 0"))
        t.remove([0])
        t.compact()
        rows.append((preset, t.database.options["history"], t.database.options["keep_seqs"], t.log().count()))
    return _answer(spark, rows, "preset string, history boolean, keep_seqs int, writes long")


@_query("SELECT 'open' AS what, 10 AS writes UNION ALL SELECT 'closed', 8")
def history_pruned_on_close(spark, d):
    """Writes before and after closing with three sequence numbers kept: those three, and each of five keys' newest of before."""
    t = _stored(spark, d, "region", "r_regionkey", keep_seqs=3)
    t.put(_table(spark, d, "region").where("r_regionkey > 0"))
    t.remove([0])
    before = t.log().count()
    t.database.close()
    return _answer(spark, [("open", before), ("closed", Database(spark, t.database.path).table("region").log().count())], "what string, writes long")


@_query("SELECT * FROM (VALUES ('FAST', FALSE, 'natural'), ('NORMAL', TRUE, 'reference'), ('given', FALSE, 'reference')) t(opened, history, ordering)")
def stored_options(spark, d):
    """Preset and options of the first opening hold at the next one that names none; others that are named count before the preset."""
    found = []
    for name, preset, options in (("FAST", "FAST", {"ordering": "natural"}), ("NORMAL", None, {}), ("given", "DURABLE", {"history": False})):
        path = workspace(spark, "database")
        Database(spark, path, preset, **options).close()
        again = Database(spark, path).options
        found.append((name, again["history"], again["ordering"]))
    return _answer(spark, found, "opened string, history boolean, ordering string")


@_query("SELECT unnest(['preset', 'option', 'ordering', 'key', 'columns', 'new table', 'no such column']) AS what, TRUE AS refused")
def refused_options(spark, d):
    t = _stored(spark, d, "region", "r_regionkey")
    db, new = t.database, lambda *a, **b: Database(spark, workspace(spark, "database"), *a, **b)
    calls = {
        "preset": lambda: new("QUICK"), "option": lambda: new(bloom=10), "ordering": lambda: new(ordering="none"), "key": lambda: db.table("region", None, "r_name"),
        "columns": lambda: db.table("region", "a int"), "new table": lambda: db.table("new"), "no such column": lambda: db.table("other", "a int", "b"),
    }

    def refused(call: Callable) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    return _answer(spark, [(name, refused(call)) for name, call in calls.items()], "what string, refused boolean")


@_query("SELECT i AS version, CASE i WHEN 1 THEN (SELECT count(*) FROM nation) WHEN 2 THEN (SELECT count(*) FROM nation) + 1 ELSE (SELECT count(*) FROM nation) + 2 END AS last_seq, CASE i WHEN 4 THEN 1 ELSE i END AS batches FROM range(1, 5) t(i)")
def commit_callbacks(spark, d):
    """Functions that are told of each commit: its version, the last sequence number, the live batches."""
    rows, told = _table(spark, d, "nation"), []
    t = Database(spark, workspace(spark, "database"), "FAST").table("nation", rows.schema, "n_nationkey")
    t.changes.on_commit.append(lambda v: told.append((v.number, v.next_seq - 1, len(v.batches))))
    t.put(rows)
    t.put([(99, "X", 1)])
    t.remove([99])
    t.compact()
    return _answer(spark, told, "version long, last_seq long, batches long")


@_query("SELECT 4 AS versions, 2 AS kept, 2 AS expired, 1 AS live_batches, (SELECT count(*) FROM nation) + 2 AS last_seq")
def manifest_queries(spark, d):
    t = _stored(spark, d, "nation", "n_nationkey", "FAST")
    t.put([(99, "X", 1)])
    t.remove([99])
    t.compact()
    manifest = t.changes.manifest
    versions, expired = len(manifest.files.names("versions")), manifest.expire(keep=2)
    now = manifest.current()
    return _answer(spark, [(versions, len(manifest.files.names("versions")), expired, len(now.batches), now.next_seq - 1)], "versions int, kept int, expired int, live_batches int, last_seq long")


@_query("SELECT n_nationkey, n_name, reverse(n_name) AS stored FROM nation")
def custom_codec(spark, d):
    """A column that is stored in another form than it is read."""
    t = Database(spark, workspace(spark, "database")).table("nation", "n_nationkey int, n_name string", "n_nationkey").codec("n_name", F.reverse, F.reverse)
    t.put(_table(spark, d, "nation").select("n_nationkey", "n_name"))
    return t.rows().join(t.changes.read().select("n_nationkey", F.col("n_name").alias("stored")), "n_nationkey")


@_query(f"SELECT {_NATION} FROM nation WHERE n_nationkey <> 3")
def promoted_reads(spark, d):
    """The merged state is kept in memory until the next commit."""
    t = _stored(spark, d, "nation", "n_nationkey", promote_reads=True)
    if t.rows().count() != t.rows().count() or not t.promoted.is_cached:
        raise RuntimeError("the state was not kept")
    t.remove([3])
    return t.rows()


@_query("SELECT count(*) AS writes, 0 AS without_time, TRUE AS in_order FROM nation")
def wall_clock(spark, d):
    t = _stored(spark, d, "nation", "n_nationkey")
    t.put([(99, "X", 1)])
    t.changes.replace(t.changes.read_all().where("n_nationkey <> 99 or op = 'D'"))
    log = t.log()
    return log.agg(F.count("*").alias("writes"), F.count_if(F.col("ts").isNull()).alias("without_time"), (F.max("ts") <= F.current_timestamp()).alias("in_order"))


# --- replication of committed versions --------------------------------------------------------------------------------


def _replica(spark: SparkSession, d: str, **options: object) -> tuple[Table, Table, Callable[[], None]]:
    """A primary, its replica, and a function that brings the replica up to date."""
    rows, root = _table(spark, d, "customer"), workspace(spark, "replication")
    primary, replica = (Database(spark, f"{root}/{x}", **options).table("customer", rows.schema, "c_custkey") for x in ("primary", "replica"))
    primary.put(rows)
    return primary, replica, lambda: replicate(spark, primary.changes, replica.changes, f"{root}/checkpoint", 4).awaitTermination()


@_query(_CHANGED)
def replica_of_commits(spark, d):
    """A write that another writer's commit overtook, and a compaction between batches: the replica has what was committed, once."""
    primary, replica, go = _replica(spark, d)
    rows = _table(spark, d, "customer")
    go()
    stale = primary.changes.manifest.current()
    primary.put(rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("changed")))
    try:
        primary.changes.commit(stale, [primary.changes._write(primary.changes.read().withColumn("c_mktsegment", F.lit("lost")), 0)])
    except Conflict:
        primary.compact()
    primary.remove(rows.where("c_custkey % 5 = 0").select("c_custkey"))
    go()
    return replica.rows()


@_query(_CHANGED)
def replica_made_anew(spark, d):
    """The primary keeps no history and compacts while the replica is away: deletions that are in no log any more reach it all the same."""
    primary, replica, go = _replica(spark, d, preset="FAST")
    rows = _table(spark, d, "customer")
    go()
    primary.put(rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("changed")))
    primary.remove(rows.where("c_custkey % 5 = 0").select("c_custkey"))
    primary.compact()
    primary.changes.manifest.vacuum()
    go()
    return replica.rows()


# --- hashes and serialised predicates ---------------------------------------------------------------------------------

#: SQL: the bytes of an ASCII text as numbers.
_ORDS = "list_transform(range(1, length(n_name) + 1), lambda i: CAST(ord(substr(n_name, CAST(i AS INTEGER), 1)) AS HUGEINT))"


@_query(f"SELECT n_nationkey, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM (SELECT n_nationkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, {_ORDS}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM nation)")
def fnv1a_hashes(spark, d):
    return _table(spark, d, "nation").select("n_nationkey", hashing.fnv1a_64_of(F.encode("n_name", "UTF-8")).alias("hash"))


@_query(f"SELECT n_nationkey, CAST(xor(list_reduce(list_prepend(4294967295::HUGEINT, {_ORDS}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 2197175160 * (x % 2)))), 4294967295) AS BIGINT) AS crc FROM nation")
def crc32c_sums(spark, d):
    return _table(spark, d, "nation").select("n_nationkey", hashing.crc32c_of(F.encode("n_name", "UTF-8")).alias("crc"))


@_query("SELECT * FROM (VALUES (0, '726FDB47DD0E0E31'), (1, '74F839C593DC67FD'), (2, '0D6C8009D9A94F5A'), (3, '85676696D7FB7E2D'), (15, 'A129CA6149BE45E5')) t(n, hash)")
def siphash_vectors(spark, d):
    """The published vectors: key bytes 0 to 15, messages of the bytes 0, 1, 2, ..."""
    messages = _answer(spark, [(n, bytearray(range(n))) for n in (0, 1, 2, 3, 15)], "n int, message binary")
    return messages.select("n", F.lpad(F.hex(hashing.siphash_2_4_of(F.col("message"), 0x0706050403020100, 0x0F0E0D0C0B0A0908)), 16, "0").alias("hash"))


@_query("SELECT c_custkey, c_custkey - 70 AS k, unhex(lpad(to_hex(CAST(c_custkey - 70 AS BIGINT)), 16, '0')) AS bytes FROM customer")
def be64_keys(spark, d):
    k = (F.col("c_custkey") - 70).cast("long")
    packed = _table(spark, d, "customer").select("c_custkey", hashing.be64_of(k).alias("bytes"))
    return packed.select("c_custkey", hashing.be64_value(F.col("bytes")).alias("k"), "bytes")


@_query("SELECT p_partkey, unhex(substr(hex(encode(p_name)), 1, 16)) AS mini FROM part")
def mini_keys_all(spark, d):
    return _table(spark, d, "part").select("p_partkey", hashing.mini_key(F.encode("p_name", "UTF-8")).alias("mini"))


_TREE = (Col("address.city") == Capture(0)) & (~(Col("opt") > 3) | Lit("BUILDING").is_in(Col("tags")) | (Col("scores").get("MACHINERY") >= Capture(1)))
_CAPTURES = ("MACHINERY", 50)


@_query(f"WITH {_ENTITY} SELECT id FROM e WHERE address.city = 'MACHINERY' AND (opt <= 3 OR (opt > 3 AND (coalesce(list_contains(tags, 'BUILDING'), FALSE) OR (scores IS NOT NULL AND id >= 50))))")
def parsed_predicate(spark, d):
    """A predicate that is read from its text."""
    tree, captures = parse(dump(_TREE, _CAPTURES))
    rows = _entity(spark, d)
    return rows.where(compile_predicate(tree, rows.schema, captures)).select("id")


@_query("SELECT unnest(['address.city', 'opt', 'tags', 'scores']) AS name")
def predicate_columns(spark, d):
    return _answer(spark, [(x,) for x in sorted(columns(parse(dump(_TREE, _CAPTURES))[0]))], "name string")
