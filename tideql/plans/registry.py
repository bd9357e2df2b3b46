"""Queries of the series engine over the test tables, and their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideql.functions.numbers import SUFFIXES, quantity, unit_for
from tideql.operators.series import accepted, retained, series_of
from tideql.plans import discovery
from tideql.plans.compiler import Samples, instant, over_range
from tideql.sources import adapters
from tideql.sources.cluster import collected
from tideql.sources.store import Store, save, shared_dir

JAN, FEB = 1704067200, 1706659200
SHIP = (788918400, 1009843200)  # 1995-01-01, 2002-01-01: the whole of the tables
DAY = 86400
AT = SHIP[0] + 1500 * DAY


def _flat(rows: DataFrame, *labels: str, digits: int = 6) -> DataFrame:
    return rows.select(*(F.col("labels")[n].alias(n) for n in labels), "t", F.round("v", digits).alias("v"))


def _range(source, query, start, end, step, *labels, guard=False, digits=6):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        return _flat(over_range(Samples(accepted(rows) if guard else rows), query, start, end, step), *labels, digits=digits)

    return run


def _instant(source, query, at, *labels, guard=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        return _flat(instant(Samples(accepted(rows) if guard else rows), query, at), *labels)

    return run


# ---- oracles: naive joins of a grid with the samples, on purpose

_EVENTS = {
    "gauge": ("event_type", "SELECT event_type, epoch_us(ts) // 1000000 AS t, value AS v, event_id AS a FROM events"),
    "user": ("event_type, user_id", "SELECT CASE WHEN user_id % 5 <> 0 THEN event_type END AS event_type, user_id::VARCHAR AS user_id, epoch_us(ts) // 1000000 AS t, value AS v, event_id AS a FROM events"),
    "counter": ("event_type", "SELECT event_type, epoch_us(ts) // 1000000 AS t, (sum(value::DECIMAL(18,2)) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS v, event_id AS a FROM events"),
}


def _guarded(kind: str) -> str:
    key, sql = _EVENTS[kind]
    return f"SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY {key} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ({sql})) WHERE newest IS NULL OR t > newest"


def _grid(start, end, step):
    return f"SELECT unnest(generate_series({start}::BIGINT, {end}::BIGINT, {step}::BIGINT)) AS g"


def _as_of(samples: str, labels: str, start, end, step) -> str:
    """(labels, t, v): the newest sample in [g - 300, g]."""
    parts = f"{labels}, " if labels else ""
    return f"SELECT {parts}g AS t, arg_max(v, t) AS v FROM ({samples}) s JOIN ({_grid(start, end, step)}) ON s.t <= g AND g - s.t <= 300 GROUP BY {parts}g"


def _rate(samples: str, labels: str, start, end, step, window) -> str:
    pairs = f"SELECT {labels}, g, t, v, lag(v) OVER (PARTITION BY {labels}, g ORDER BY t) AS pv FROM ({samples}) s JOIN ({_grid(start, end, step)}) ON s.t <= g AND s.t > g - {window}"
    return f"SELECT {labels}, g AS t, sum(CASE WHEN pv IS NULL THEN 0 WHEN v < pv AND NOT isnan(pv) THEN v ELSE v - pv END) / (max(t) - min(t)) AS v FROM ({pairs}) GROUP BY {labels}, g HAVING count(*) >= 2"


def _rounded(sql: str, labels: str, digits: int = 6) -> str:
    parts = f"{labels}, " if labels else ""
    return f"SELECT {parts}t, round(v, {digits}) AS v FROM ({sql})"


_SHIP_LABELS = "l_returnflag, l_linestatus"
_SHIP_VALUE = {"gross": "sum(l_extendedprice::DECIMAL(18,2))::DOUBLE", "discount": "sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2))::DOUBLE", "rows": "count(*)::DOUBLE"}


def _ship(what: str, where: str = "true") -> str:
    return f"SELECT l_returnflag, l_linestatus, epoch_us(date_trunc('day', l_shipdate)::TIMESTAMP) // 1000000 AS t, {_SHIP_VALUE[what]} AS v FROM lineitem WHERE {where} GROUP BY ALL"


def _ship_grid(what: str, where: str = "true", start=SHIP[0], end=SHIP[1], step=DAY) -> str:
    return _as_of(_ship(what, where), _SHIP_LABELS, start, end, step)


def _order() -> str:
    return "SELECT o_orderstatus, o_orderpriority, epoch_us(date_trunc('day', o_orderdate)::TIMESTAMP) // 1000000 AS t, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL"


_FINITE = "isfinite(v)"
_FLAG = "l_returnflag IN ('A', 'R')"
_E6H = (JAN, FEB, 21600)
_QUERIES: dict = {}
_SQL: dict = {}


def _add(name, run, sql=None):
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _ship_query(name, query, sql, *labels, at=None):
    run = _instant(adapters.ship_daily, query, at, *labels) if at else _range(adapters.ship_daily, query, *SHIP, DAY, *labels)
    _add(name, run, _rounded(sql, ", ".join(labels)))


SL = ("l_returnflag", "l_linestatus")
_ship_query("sel_name", "ship_gross", _ship_grid("gross"), *SL)
_ship_query("sel_nameless_regex", '{__name__=~"ship_g.*", l_linestatus="O"}', _ship_grid("gross", "l_linestatus = 'O'"), *SL)
_ship_query("sel_all", "sum({}) by (l_returnflag)", "SELECT l_returnflag, t, sum(v) AS v FROM (" + " UNION ALL ".join(_ship_grid(k) for k in _SHIP_VALUE) + ") GROUP BY 1, 2", "l_returnflag")
_ship_query("match_eq", 'ship_rows{l_returnflag="N"}', _ship_grid("rows", "l_returnflag = 'N'"), *SL)
_ship_query("match_ne", 'ship_rows{l_returnflag!="N"}', _ship_grid("rows", "l_returnflag <> 'N'"), *SL)
_ship_query("match_re", 'ship_rows{l_returnflag=~"A|R"}', _ship_grid("rows", _FLAG), *SL)
_ship_query("match_nre", 'ship_rows{l_returnflag!~"A|R"}', _ship_grid("rows", f"NOT {_FLAG}"), *SL)
_ship_query("match_anchored", 'ship_rows{l_linestatus=~"[OF].+|O"}', _ship_grid("rows", "l_linestatus = 'O'"), *SL)
_ship_query("sum_all", "sum(ship_gross)", f"SELECT t, sum(v) AS v FROM ({_ship_grid('gross')}) GROUP BY t")
_ship_query("sum_by_one", 'sum(ship_gross{l_returnflag=~"A|R"}) by (l_linestatus)', f"SELECT l_linestatus, t, sum(v) AS v FROM ({_ship_grid('gross', _FLAG)}) GROUP BY 1, 2", "l_linestatus")
_ship_query("sum_by_two", "sum(ship_discount) by (l_linestatus, l_returnflag)", _ship_grid("discount"), "l_linestatus", "l_returnflag")
_ship_query("sum_by_missing", "sum(ship_rows) by (nowhere)", f"SELECT t, sum(v) AS v FROM ({_ship_grid('rows')}) GROUP BY t")
_ship_query("sum_prefix_by", "sum by (l_returnflag,) (ship_rows)", f"SELECT l_returnflag, t, sum(v) AS v FROM ({_ship_grid('rows')}) GROUP BY 1, 2", "l_returnflag")


def _pair(a, b, value, extra=""):
    return f"SELECT {_SHIP_LABELS}, t, {value} AS v FROM ({a}) a JOIN (SELECT {_SHIP_LABELS}, t, v AS w FROM ({b})) b USING ({_SHIP_LABELS}, t) {extra}"


_ship_query("vec_sub_nested", "sum(ship_gross - (ship_discount + ship_rows)) by (l_returnflag)", f"SELECT l_returnflag, t, sum(v) AS v FROM ({_pair(_ship_grid('gross'), _pair(_ship_grid('discount'), _ship_grid('rows'), 'v + w'), 'v - w')}) GROUP BY 1, 2", "l_returnflag")
_ship_query("vec_mul", "ship_rows * ship_rows", _pair(_ship_grid("rows"), _ship_grid("rows"), "v * w"), *SL)
_ship_query("vec_div", "ship_discount / ship_gross", _pair(_ship_grid("discount"), _ship_grid("gross"), "v / w"), *SL)
_ship_query("vec_unmatched_dropped", 'ship_gross - ship_discount{l_returnflag="A"}', _pair(_ship_grid("gross"), _ship_grid("discount", "l_returnflag = 'A'"), "v - w"), *SL)
_ship_query("vec_scalar_add", "ship_rows + 0.5", f"SELECT {_SHIP_LABELS}, t, v + 0.5 AS v FROM ({_ship_grid('rows')})", *SL)
_ship_query("scalar_vec_sub", "1000 - ship_rows", f"SELECT {_SHIP_LABELS}, t, 1000 - v AS v FROM ({_ship_grid('rows')})", *SL)
_ship_query("scalar_const_fold", "ship_rows * (2 + 3 * 4 - 6 / 4)", f"SELECT {_SHIP_LABELS}, t, v * 12.5 AS v FROM ({_ship_grid('rows')})", *SL)
_ship_query("div_by_zero_range_dropped", "ship_rows / (ship_rows - ship_rows{l_linestatus=\"F\"} * 1)", f"SELECT {_SHIP_LABELS}, t, v FROM ({_ship_grid('rows')}) WHERE false", *SL)
_ship_query("div_by_zero_instant", "ship_rows / (ship_rows - ship_rows)", f"SELECT {_SHIP_LABELS}, t, 'Infinity'::DOUBLE AS v FROM ({_ship_grid('rows', start=AT, end=AT)})", *SL, at=AT)
_ship_query("scalar_as_vector_is_empty", "sum(5)", "SELECT 0::BIGINT AS t, 0.0::DOUBLE AS v WHERE false")
_ship_query("matrix_points", "sum(ship_rows) by (l_linestatus)", f"SELECT l_linestatus, t, sum(v) AS v FROM ({_ship_grid('rows')}) GROUP BY 1, 2", "l_linestatus")
_add("order_sum_by_status", _range(adapters.order_daily, "sum(order_total) by (o_orderstatus)", *SHIP, DAY, "o_orderstatus"), _rounded(f"SELECT o_orderstatus, t, sum(v) AS v FROM ({_as_of(_order(), 'o_orderstatus, o_orderpriority', *SHIP, DAY)}) GROUP BY 1, 2", "o_orderstatus"))

_add("match_absent_label", _range(adapters.event_gauge_user, 'event_value_by_user{event_type=""}', JAN, FEB, 600, "user_id", guard=True), _rounded(_as_of(f"SELECT * FROM ({_guarded('user')}) WHERE event_type IS NULL", "user_id", JAN, FEB, 600), "user_id"))
_add("range_lookback_gaps", _range(adapters.event_gauge, "event_value", JAN, FEB, 60, "event_type", guard=True), _rounded(_as_of(_guarded("gauge"), "event_type", JAN, FEB, 60), "event_type"))
_add("instant_lookback", _instant(adapters.event_gauge, "event_value", JAN + 12 * DAY + 137, "event_type", guard=True), _rounded(_as_of(_guarded("gauge"), "event_type", JAN + 12 * DAY + 137, JAN + 12 * DAY + 137, 1), "event_type"))
_add("stale_series_empty_tail", _range(adapters.event_gauge, "event_value", FEB - 2 * DAY, FEB + DAY, 300, "event_type", guard=True), _rounded(_as_of(_guarded("gauge"), "event_type", FEB - 2 * DAY, FEB + DAY, 300), "event_type"))
_add("sum_by_absent_label", _range(adapters.event_gauge_user, "sum(event_value_by_user) by (event_type)", JAN, FEB, 600, "event_type", guard=True), _rounded(f"SELECT event_type, t, sum(v) AS v FROM ({_as_of(_guarded('user'), 'event_type, user_id', JAN, FEB, 600)}) GROUP BY 1, 2", "event_type"))
_add("rate_counter", _range(adapters.event_counter, "rate(event_value_total[1d])", *_E6H, "event_type", guard=True), _rounded(_rate(_guarded("counter"), "event_type", *_E6H, DAY), "event_type"))
_add("rate_reset", _range(adapters.event_reset_counter, "rate(event_raw_total[1d])", *_E6H, "event_type", guard=True), _rounded(_rate(_guarded("gauge"), "event_type", *_E6H, DAY), "event_type"))
_add("rate_wide_window", _range(adapters.event_reset_counter, "rate(event_raw_total[12h])", JAN, FEB, 900, "event_type", guard=True, digits=9), _rounded(_rate(_guarded("gauge"), "event_type", JAN, FEB, 900, DAY // 2), "event_type", 9))
_add("irate_alias", _range(adapters.event_counter, "irate(event_value_total[1d])", *_E6H, "event_type", guard=True), _rounded(_rate(_guarded("counter"), "event_type", *_E6H, DAY), "event_type"))
_add("rate_short_window_gaps", _range(adapters.event_counter, "rate(event_value_total[30m])", JAN, FEB, 3600, "event_type", guard=True), _rounded(_rate(_guarded("counter"), "event_type", JAN, FEB, 3600, 1800), "event_type"))
_add(
    "rate_two_windows",
    _range(adapters.event_counter, "rate(event_value_total[12h]) - rate(event_value_total[1d])", *_E6H, "event_type", guard=True),
    _rounded(f"SELECT event_type, t, a.v - b.v AS v FROM ({_rate(_guarded('counter'), 'event_type', *_E6H, DAY // 2)}) a JOIN ({_rate(_guarded('counter'), 'event_type', *_E6H, DAY)}) b USING (event_type, t)", "event_type"),
)
_add("sum_of_rate_by", _range(adapters.event_counter, "sum(rate(event_value_total[1d])) by (event_type)", *_E6H, "event_type", guard=True), _rounded(_rate(_guarded("counter"), "event_type", *_E6H, DAY), "event_type"))


def _dedupe(order):
    def run(spark, sf_dir):
        rows = adapters.event_gauge(spark, sf_dir).withColumn("arrival", order(F.col("arrival")))
        return accepted(rows).select(F.col("labels")["event_type"].alias("event_type"), "t", "v")

    return run


_add("dedupe_out_of_order", _dedupe(lambda a: a), f"SELECT event_type, t, v FROM ({_guarded('gauge')})")
_SCRAMBLED = "SELECT event_type, epoch_us(ts) // 1000000 AS t, value AS v, ((event_id * 7919) % 100003) * 1000000 + event_id AS a FROM events"
_add(
    "dedupe_scrambled_arrival",
    _dedupe(lambda a: ((a * 7919) % 100003) * 1000000 + a),
    f"SELECT event_type, t, v FROM (SELECT *, max(t) OVER (PARTITION BY event_type ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ({_SCRAMBLED})) WHERE newest IS NULL OR t > newest",
)
_KEEP = 5 * DAY
_add("retention_exact", lambda s, d: retained(adapters.event_gauge_user(s, d), FEB, _KEEP).select(F.col("labels")["user_id"].alias("user_id"), "t", "v"), f"SELECT user_id, t, v FROM ({_EVENTS['user'][1]}) WHERE t >= {FEB - _KEEP}")
_add(
    "series_after_retention",
    lambda s, d: series_of(retained(adapters.event_gauge_user(s, d), FEB, _KEEP)).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), "first_t", "last_t", "n"),
    f"SELECT event_type, user_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM ({_EVENTS['user'][1]}) WHERE t >= {FEB - _KEEP} GROUP BY 1, 2",
)


def _both(s, d):
    return Samples(adapters.event_gauge_user(s, d).drop("arrival").unionByName(adapters.ship_daily(s, d).drop("arrival")))


_add("label_names", lambda s, d: discovery.names(_both(s, d)), "SELECT unnest(['__name__', 'event_type', 'l_linestatus', 'l_returnflag', 'user_id']) AS name")
_add("label_values", lambda s, d: discovery.values(_both(s, d), "user_id"), "SELECT DISTINCT user_id::VARCHAR AS value FROM events")
_add("label_values_name", lambda s, d: discovery.values(_both(s, d), "__name__"), "SELECT unnest(['event_value_by_user', 'ship_discount', 'ship_gross', 'ship_rows']) AS value")
_add("label_values_matched", lambda s, d: discovery.values(_both(s, d), "user_id", ['{event_type="click"}', '{user_id=~"1.*"}']), f"SELECT DISTINCT user_id AS value FROM ({_EVENTS['user'][1]}) WHERE event_type = 'click' OR user_id LIKE '1%'")


def _sets(rows: DataFrame) -> DataFrame:
    return rows.select("metric", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"))


_add("series_matched", lambda s, d: _sets(discovery.sets(_both(s, d), ['event_value_by_user{event_type=~"c.*"}', 'event_value_by_user{user_id="1"}'])), f"SELECT DISTINCT 'event_value_by_user' AS metric, event_type, user_id FROM ({_EVENTS['user'][1]}) WHERE event_type LIKE 'c%' OR user_id = '1'")
_add(
    "series_window",
    lambda s, d: _sets(discovery.sets(_both(s, d), ["event_value_by_user"], JAN + 3 * DAY, JAN + 4 * DAY)),
    f"SELECT 'event_value_by_user' AS metric, event_type, user_id FROM ({_EVENTS['user'][1]}) GROUP BY 2, 3 HAVING max(t) >= {JAN + 3 * DAY} AND min(t) <= {JAN + 4 * DAY}",
)
_add(
    "stats",
    lambda s, d: discovery.stats(_both(s, d)),
    f"""WITH x AS (SELECT 'u' || coalesce(event_type, '') || '/' || user_id AS k, count(*) AS n FROM ({_EVENTS['user'][1]}) GROUP BY 1
    UNION ALL SELECT l_returnflag || l_linestatus || m, n FROM (SELECT l_returnflag, l_linestatus, count(DISTINCT date_trunc('day', l_shipdate)) AS n FROM lineitem GROUP BY 1, 2), (SELECT unnest(['a', 'b', 'c']) AS m))
    SELECT count(*) AS series, sum(n)::BIGINT AS samples FROM x""",
)

_TAILS = ["", "m", "k", "M", "G", "Ki", "Mi", "Gi", "e3", "E2", "E", "Zi", "n", "e", " "]


def _quantity(s, d):
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("p_partkey") % 15 + 1).cast("int"))
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.col("p_size").cast("string"), tail).alias("text"))
    return rows.select("p_partkey", "text", quantity(F.col("text")).alias("value"))


_FACTORS = " ".join(f"WHEN {i} THEN {SUFFIXES[t]!r}::DOUBLE" for i, t in enumerate(_TAILS) if t in SUFFIXES)
_add(
    "quantity_parse",
    _quantity,
    f"SELECT p_partkey, p_size::VARCHAR || [{', '.join(repr(t) for t in _TAILS)}][p_partkey % 15 + 1] AS text, p_size::DOUBLE * CASE p_partkey % 15 {_FACTORS} WHEN 8 THEN 1000.0::DOUBLE WHEN 9 THEN 100.0::DOUBLE WHEN 14 THEN 1.0::DOUBLE END AS value FROM part",
)
_add(
    "unit_for",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", unit_for(F.element_at(F.array(*map(F.lit, ("cpu", "memory", "storage", "pods", "ephemeral-storage"))), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("unit")),
    "SELECT p_partkey, ['core', 'byte', 'byte', 'integer', 'byte'][p_partkey % 5 + 1] AS unit FROM part",
)


_ALIVE = "n_nationkey % 5 > 1"


def _cluster(spark, sf_dir):
    """Documents of a cluster made of nations and suppliers: each nation is a node; of five one
    does not answer and one answers with what is no summary. Suppliers are pods of their
    nation's node, whose list tells the image of some, and an empty text of others."""
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    name, pod = F.struct(F.col("n_name").alias("name")), F.struct(F.col("s_name").alias("name"), F.concat(F.lit("ns"), "s_nationkey").alias("namespace"))
    nodes = nation.agg(F.to_json(F.struct(F.collect_list(F.struct(name.alias("metadata"))).alias("items"))).alias("doc"))
    image = F.concat(F.lit("asked:"), F.col("s_suppkey") % 7)
    told = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("told:"), "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, "")
    asks = F.struct(F.array(F.struct(F.lit("main").alias("name"), image.alias("image"))).alias("containers"))
    tells = F.struct(F.array(F.struct(F.lit("main").alias("name"), told.alias("image"))).alias("containerStatuses"))
    pods = supplier.agg(F.to_json(F.struct(F.collect_list(F.struct(pod.alias("metadata"), asks.alias("spec"), tells.alias("status"))).alias("items"))).alias("doc"))
    box = [F.struct(F.lit(c).alias("name"), F.struct((F.col("s_suppkey") + n).alias("usageBytes")).alias("memory")) for n, c in enumerate(("main", "side"))]
    runs = supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.struct(pod.alias("podRef"), F.array(*box).alias("containers")).alias("p"))
    runs = runs.groupBy("n_nationkey").agg(F.collect_list("p").alias("pods"))
    right = F.to_json(F.struct(F.struct().alias("node"), F.coalesce("pods", F.array()).alias("pods")))
    doc = F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).when(F.col("n_nationkey") % 5 == 1, F.lit("<html>gateway error</html>")).otherwise(right)
    return nodes, pods, nation.join(runs, "n_nationkey", "left").select(F.col("n_name").alias("node"), doc.alias("doc"))


def _collected(metric: str, *labels: str):
    def run(spark, sf_dir):
        rows = collected(*_cluster(spark, sf_dir), AT).where(F.col("metric") == metric)
        return rows.select(*(F.col("labels")[n].alias(n) for n in labels), "t", "v")

    return run


_add("ingest_up", _collected("up", "instance", "job"), f"SELECT n_name AS instance, 'tideql' AS job, {AT}::BIGINT AS t, CASE WHEN {_ALIVE} THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM nation")
_add(
    "ingest_container_image_join",
    _collected("container_memory_working_set_bytes", "namespace", "pod", "container", "image", "instance"),
    f"""SELECT 'ns' || s_nationkey AS namespace, s_name AS pod, c AS container,
      CASE WHEN c = 'side' THEN 'unknown' WHEN s_suppkey % 3 = 0 THEN 'told:' || s_suppkey ELSE 'asked:' || s_suppkey % 7 END AS image,
      n_name AS instance, {AT}::BIGINT AS t, (s_suppkey + CASE WHEN c = 'side' THEN 1 ELSE 0 END)::DOUBLE AS v
    FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest(['main', 'side']) AS c) WHERE {_ALIVE}""",
)


def _stored(query: str, start: int, end: int, step: int, *labels: str):
    """Over a store written in the session's shared folder, once a session and table."""

    def run(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _STORES:
            _STORES[key] = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
            save(accepted(adapters.event_gauge_user(spark, sf_dir)), _STORES[key])
        return _flat(over_range(Store(spark, _STORES[key]), query, start, end, step), *labels)

    return run


_STORES: dict = {}
_add(
    "store_matched_series",
    _stored('event_value_by_user{event_type="click",user_id=~"1.*"}', JAN, FEB, 600, "user_id"),
    _rounded(_as_of(f"SELECT * FROM ({_guarded('user')}) WHERE event_type = 'click' AND user_id LIKE '1%'", "user_id", JAN, FEB, 600), "user_id"),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["sum_by_one"](spark, sf_dir)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
