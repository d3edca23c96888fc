"""The registered queries of the language, each with DuckDB SQL of the same rows.

Statements go through the engine as text; ``{d}`` is the directory of the tables.
Queries over JSON, CSV and listings write their input to the shared folder first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.engine import Engine
from tarn.sources import paths

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "select l_returnflag, l_linestatus, count() as n, sum(l_quantity) as qty, max(l_extendedprice) as top from parquet '{d}/lineitem.parquet' where l_discount >= 0.05 group by l_returnflag, l_linestatus order by l_returnflag;"

# name: (statement, the same in DuckDB's SQL)
STATEMENTS: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, max(l_extendedprice) AS top FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL"),
    "project_alias": ("select n_name as nm, n_regionkey rk from parquet '{d}/nation.parquet';", "SELECT n_name AS nm, n_regionkey AS rk FROM nation"),
    "table_alias": ("select n.n_name as a, n_regionkey as b from parquet '{d}/nation.parquet' as n where n.n_nationkey != 3;", "SELECT n_name AS a, n_regionkey AS b FROM nation WHERE n_nationkey <> 3"),
    "constants": ("select n_nationkey as k, 'x' as s, 2.5 as d, true as t, 7 as seven from parquet '{d}/nation.parquet';", "SELECT n_nationkey AS k, 'x' AS s, 2.5::DOUBLE AS d, true AS t, 7::DOUBLE AS seven FROM nation"),
    "filter_compare": (
        "select l_orderkey, l_linenumber from parquet '{d}/lineitem.parquet' where l_quantity > 10 and l_quantity >= 11 and l_linenumber < 6 and l_linenumber <= 5 and l_returnflag = 'R' and l_linestatus <> 'X';",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity >= 11 AND l_linenumber < 6 AND l_linenumber <= 5 AND l_returnflag = 'R' AND l_linestatus <> 'X'",
    ),
    "compare_values": (
        "select p_partkey as k, p_size > 10 as gt, p_size >= 10 as ge, p_size < 10 as lt, p_size <= 10 as le, p_size = 10 as eq, p_size != 10 as ne, p_name > p_brand as text_gt from parquet '{d}/part.parquet';",
        "SELECT p_partkey AS k, p_size > 10 AS gt, p_size >= 10 AS ge, p_size < 10 AS lt, p_size <= 10 AS le, p_size = 10 AS eq, p_size <> 10 AS ne, p_name > p_brand AS text_gt FROM part",
    ),
    "filter_and_or_flat": ("select o_orderkey from parquet '{d}/orders.parquet' where o_orderstatus = 'F' or o_orderpriority = '1-URGENT' and o_custkey < 500;", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_custkey < 500"),
    "strict_null_logic": ("select l_orderkey as k, l_linenumber as l, (l_quantity > 10 or null) is null as o, (l_quantity > 10 and null) is null as a from parquet '{d}/lineitem.parquet';", "SELECT l_orderkey AS k, l_linenumber AS l, true AS o, true AS a FROM lineitem"),
    "arith": ("select l_orderkey as k, l_linenumber as l, l_extendedprice * (1 - l_discount) as net, l_quantity + l_linenumber - 2 as q from parquet '{d}/lineitem.parquet';", "SELECT l_orderkey AS k, l_linenumber AS l, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_linenumber - 2 AS q FROM lineitem"),
    "divide_ieee": (
        "select c_custkey as k, c_acctbal / (c_nationkey - 5) as q, (c_nationkey - 5) / (c_nationkey - 5) is null as z from parquet '{d}/customer.parquet' where c_nationkey != 5;",
        "SELECT c_custkey AS k, c_acctbal / (c_nationkey - 5) AS q, false AS z FROM customer WHERE c_nationkey <> 5",
    ),
    "divide_by_zero": (
        "select c_custkey as k, c_nationkey / 0 > 1000000 as up, (0 - c_nationkey) / 0 < 0 as down from parquet '{d}/customer.parquet' where c_nationkey > 0;",
        "SELECT c_custkey AS k, true AS up, true AS down FROM customer WHERE c_nationkey > 0",
    ),
    "number_fn": ("select p_partkey as k, number(p_name) as a, number(p_size) as b, number('12.5') as c from parquet '{d}/part.parquet';", "SELECT p_partkey AS k, try_cast(p_name AS DOUBLE) AS a, p_size::DOUBLE AS b, 12.5::DOUBLE AS c FROM part"),
    "number_vs_text": ("select p_partkey as k, p_brand > 5 as a, p_size = '10' as b, p_size = 10 as c from parquet '{d}/part.parquet';", "SELECT p_partkey AS k, p_brand > '5.0' AS a, p_size::VARCHAR = '10' AS b, p_size = 10 AS c FROM part"),
    "is_null": ("select doc_id from parquet '{d}/documents.parquet' where nothing is null;", "SELECT doc_id FROM documents"),
    "is_not_null": ("select count() as n from parquet '{d}/labels.parquet' where quality is not null and nothing is not null or quality = 1;", "SELECT count(*) AS n FROM labels WHERE quality = 1"),
    "coalesce_fn": ("select event_id, coalesce(nothing, event_type, 'none') as t from parquet '{d}/events.parquet';", "SELECT event_id, coalesce(event_type, 'none') AS t FROM events"),
    "count_all": ("select count(*) as a, count() as b from parquet '{d}/lineitem.parquet';", "SELECT count(*) AS a, count(*) AS b FROM lineitem"),
    "count_col": ("select o_orderpriority as p, count(o_orderkey) as n, count(nothing) as none from parquet '{d}/orders.parquet' group by o_orderpriority;", "SELECT o_orderpriority AS p, count(o_orderkey) AS n, 0::BIGINT AS none FROM orders GROUP BY 1"),
    "count_empty": ("select count() as n from parquet '{d}/orders.parquet' where o_orderkey < 0;", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0"),
    "missing_path": ("select count() as n, sum(x) as s from json '{d}/there/is/nothing.json';", "SELECT 0::BIGINT AS n, 0::DOUBLE AS s"),
    "sum_group": ("select l_shipdate as d, sum(l_quantity) as q from parquet '{d}/lineitem.parquet' group by l_shipdate;", "SELECT l_shipdate AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "sum_empty_zero": ("select sum(l_quantity) as q, sum(l_returnflag) as t from parquet '{d}/lineitem.parquet' where l_orderkey < 0;", "SELECT 0::DOUBLE AS q, 0::DOUBLE AS t"),
    "sum_of_text": ("select sum(l_returnflag) as t, sum(l_linestatus) as u from parquet '{d}/lineitem.parquet';", "SELECT 0::DOUBLE AS t, 0::DOUBLE AS u"),
    "min_max": ("select p_brand as b, min(p_size) as a, max(p_size) as z, min(p_name) as f, max(p_name) as l, max(p_retailprice) as m from parquet '{d}/part.parquet' group by p_brand;", "SELECT p_brand AS b, min(p_size) AS a, max(p_size) AS z, min(p_name) AS f, max(p_name) AS l, max(p_retailprice) AS m FROM part GROUP BY 1"),
    "max_struct": ("select r_name as r, max(__all__).r_regionkey as k from parquet '{d}/region.parquet' group by r_name;", "SELECT r_name AS r, max(r_regionkey) AS k FROM region GROUP BY 1"),
    "max_row_latest": ("select user_id as u, max_row(event_id, event_type) as t, max_row(event_id, __all__).value as v from parquet '{d}/events.parquet' group by user_id;", "SELECT user_id AS u, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events GROUP BY 1"),
    "agg_expr": ("select l_linenumber as l, sum(l_quantity * 2) / count() as a, max(l_quantity) - min(l_quantity) as r from parquet '{d}/lineitem.parquet' group by l_linenumber;", "SELECT l_linenumber AS l, sum(l_quantity * 2) / count(*) AS a, max(l_quantity) - min(l_quantity) AS r FROM lineitem GROUP BY 1"),
    "bare_column_is_key": ("select n_regionkey as k, n_regionkey * 2 as t, 'c' as c, count() as n from parquet '{d}/nation.parquet' group by n_regionkey;", "SELECT n_regionkey AS k, n_regionkey * 2.0::DOUBLE AS t, 'c' AS c, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "bare_column": ("select c_custkey as k, c_name as n, c_nationkey + 1 as m, count() as c from parquet '{d}/customer.parquet' group by c_custkey;", "SELECT c_custkey AS k, c_name AS n, c_nationkey + 1.0::DOUBLE AS m, 1::BIGINT AS c FROM customer"),
    "group_expr": ("select p_size > 25 as big, count() as n from parquet '{d}/part.parquet' group by p_size > 25;", "SELECT p_size > 25 AS big, count(*) AS n FROM part GROUP BY 1"),
    "group_not_selected": ("select count() as n, min(o_orderkey) as k from parquet '{d}/orders.parquet' group by o_custkey, o_orderstatus;", "SELECT count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY o_custkey, o_orderstatus"),
    "group_null_key": ("select nothing as k, count() as n from parquet '{d}/orders.parquet' group by nothing;", "SELECT NULL::VARCHAR AS k, count(*) AS n FROM orders"),
    "order_multi": ("select k, s from (select o_orderkey as k, o_orderstatus as s, o_custkey as c from parquet '{d}/orders.parquet' order by s desc, c, k limit 50);", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders ORDER BY o_orderstatus DESC, o_custkey, o_orderkey LIMIT 50"),
    "order_desc_nulls": (
        "select k, v from (select p_partkey as k, number(coalesce(none, p_type)) as v from parquet '{d}/part.parquet' order by v desc, k desc limit 20);",
        "SELECT p_partkey AS k, NULL::DOUBLE AS v FROM part ORDER BY p_partkey DESC LIMIT 20",
    ),
    "topk": ("select l_orderkey, l_linenumber, l_extendedprice from parquet '{d}/lineitem.parquet' order by l_extendedprice desc, l_orderkey, l_linenumber limit 10;", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10"),
    "limit_n": ("select count() as n from (select l_orderkey from parquet '{d}/lineitem.parquet' limit 10);", "SELECT 10::BIGINT AS n"),
    "inline_view": ("select f, q from (select l_returnflag as f, sum(l_quantity) as q from parquet '{d}/lineitem.parquet' group by l_returnflag) t where t.q > 10;", "SELECT l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 10"),
    "inline_view_nested": ("select max(n) as m from (select c, count() as n from (select o_custkey as c from parquet '{d}/orders.parquet' where o_orderstatus = 'O') group by c);", "SELECT max(n) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"),
    "join_equi": ("select o.o_orderkey as k, c.c_name as c from parquet '{d}/orders.parquet' o join parquet '{d}/customer.parquet' c on o.o_custkey = c.c_custkey where c.c_acctbal > 0;", "SELECT o_orderkey AS k, c_name AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0"),
    "join_three_way": (
        "select n.n_name as n, count() as c, sum(o.o_custkey) as s from parquet '{d}/orders.parquet' o join parquet '{d}/customer.parquet' c on o.o_custkey = c.c_custkey join parquet '{d}/nation.parquet' n on c.c_nationkey = n.n_nationkey group by n.n_name;",
        "SELECT n_name AS n, count(*) AS c, sum(o_custkey::DOUBLE) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "join_theta": ("select r.r_name as r, n.n_name as n from parquet '{d}/region.parquet' r join parquet '{d}/nation.parquet' n on r.r_regionkey < n.n_regionkey;", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey < n_regionkey"),
    "join_self": ("select a.n_name as x, b.n_name as y from parquet '{d}/nation.parquet' a join parquet '{d}/nation.parquet' b on a.n_nationkey + 1 = b.n_nationkey;", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey"),
    "join_views": (
        "select p.b as b, p.n as n, q.m as m from (select p_brand as b, count() as n from parquet '{d}/part.parquet' group by p_brand) p join (select p_brand as b, max(p_size) as m from parquet '{d}/part.parquet' group by p_brand) q on p.b = q.b;",
        "SELECT p_brand AS b, count(*) AS n, max(p_size) AS m FROM part GROUP BY 1",
    ),
    "unqualified_is_left": ("select n_name as n from parquet '{d}/nation.parquet' a join parquet '{d}/region.parquet' b on a.n_regionkey = b.r_regionkey where r_name is null;", "SELECT n_name AS n FROM nation"),
    "lateral_array": ("select vec_id, x from parquet '{d}/embeddings.parquet' lateral view embedding x;", "SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings"),
    "lateral_shadow": ("select e.vec_id as v, e.embedding as x from parquet '{d}/embeddings.parquet' e lateral view embedding where embedding > 0;", "SELECT v, x FROM (SELECT vec_id AS v, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE x > 0"),
    "lateral_index": ("select vec_id, embedding[0] as a, embedding['1'] as b, embedding[100000] as c from parquet '{d}/embeddings.parquet';", "SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, NULL::DOUBLE AS c FROM embeddings"),
    "lateral_scalar": ("select n_nationkey as k, x, y from parquet '{d}/nation.parquet' lateral view n_name as x lateral view __all__ as r lateral view r.n_regionkey as y;", "SELECT n_nationkey AS k, n_name AS x, n_regionkey AS y FROM nation"),
    "lateral_none": ("select count() as n from parquet '{d}/nation.parquet' lateral view nothing as x;", "SELECT 0::BIGINT AS n"),
    "lateral_chain": ("select l, count() as n, max(x) as m from (select label as l, x from parquet '{d}/embeddings.parquet' lateral view embedding x lateral view x[0] y) group by l;", "SELECT label AS l, count(*) AS n, max(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1"),
}

_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"

# name: (statement over files {f} made by _events, the same in DuckDB's SQL)
FILE_STATEMENTS: dict[str, tuple[str, str]] = {
    "json_scan": ("select event_id, user_id, event_type, value from json '{f}/lines' where user_id < 50;", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id < 50"),
    "json_idx": ("select event_id, props.k as k, props['k'] as b, props['K'] as none, tags[0] as t from json '{f}/lines';", f"SELECT event_id, {_K} AS k, {_K} AS b, NULL::VARCHAR AS none, event_type AS t FROM events"),
    "json_lateral": ("select event_id, x from json '{f}/lines' lateral view tags x;", "SELECT event_id, unnest([event_type, user_id::VARCHAR]) AS x FROM events"),
    "json_all": ("select r.event_id as e, r.props.k as k from (select __all__ as r from json '{f}/lines') t;", f"SELECT event_id AS e, {_K} AS k FROM events"),
    "json_group": ("select event_type as t, count() as n, sum(props.k) as s, max(event_id) as m from json '{f}/lines' group by event_type;", f"SELECT event_type AS t, count(*) AS n, sum({_K})::DOUBLE AS s, max(event_id) AS m FROM events GROUP BY 1"),
    "json_arrays": ("select event_id, props.k as k from json '{f}/arrays';", f"SELECT event_id, {_K} AS k FROM events"),
    "json_side_by_side": ("select count() as n, sum(event_id) as s from json '{f}/side';", "SELECT count(*) AS n, sum(event_id)::DOUBLE AS s FROM events"),
    "json_gzip": ("select count() as n, sum(event_id) as s from json '{f}/gzip';", "SELECT count(*) AS n, sum(event_id)::DOUBLE AS s FROM events"),
    "json_mixed_field": ("select event_id, number(mixed) as n, mixed = '5' as five, mixed is null as none from json '{f}/lines';", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 10)::DOUBLE WHEN 1 THEN (event_id % 10)::DOUBLE END AS n, CASE WHEN event_id % 3 < 2 THEN event_id % 10 = 5 END AS five, event_id % 3 = 2 AS none FROM events"),
    "json_join": ("select e.event_id as e, c.c_name as c from json '{f}/lines' e join parquet '{d}/customer.parquet' c on e.user_id = c.c_custkey;", "SELECT event_id AS e, c_name AS c FROM events JOIN customer ON user_id = c_custkey"),
    "csv_scan": ("select number(event_id) as e, event_type as t, note from csv '{f}/csv.csv' where number(user_id) < 100;", "SELECT event_id::DOUBLE AS e, event_type AS t, CASE WHEN event_id % 2 = 0 THEN event_type || ', \"q\"' END AS note FROM events WHERE user_id < 100"),
    "csv_headers": ("select event_type as t, count() as n, sum(event_id) as s from csv '{f}/swapped' group by event_type;", "SELECT event_type AS t, count(*) AS n, sum(event_id)::DOUBLE AS s FROM events GROUP BY 1"),
    "csv_gzip": ("select count() as n, sum(event_id) as s from csv '{f}/csvgz';", "SELECT count(*) AS n, sum(event_id)::DOUBLE AS s FROM events"),
    "json_nul": ("select count() as n, sum(event_id) as s, max(event_type) as t from json '{f}/nul';", "SELECT count(*) AS n, sum(event_id)::DOUBLE AS s, max(event_type) AS t FROM events"),
    "json_layouts_beside": ("select count() as n, sum(event_id) as s, sum(props.k) as k from json '{f}/beside';", f"SELECT 2 * count(*) AS n, 2 * sum(event_id)::DOUBLE AS s, 2 * sum({_K})::DOUBLE AS k FROM events"),
    "insert_folder": ("select event_id, event_type as t from csv '{f}/many';", "SELECT event_id::DOUBLE::VARCHAR AS event_id, event_type AS t FROM events"),
    "insert_json": ("select event_id, event_type from json '{f}/json.json';", "SELECT event_id, event_type FROM events"),
    "insert_csv": ("select event_id from csv '{f}/csv.csv';", "SELECT event_id::DOUBLE::VARCHAR AS event_id FROM events"),
    "dir_list": ("select extension as x, count() as n from dir '{f}/listed' where size > 0 and parent = '{f}/listed' group by extension;", "SELECT 'json' AS x, 1::BIGINT AS n"),
}


def _statement(text: str) -> Query:
    return lambda spark, d: Engine(spark).sql(text.replace("{d}", d))


def _events(spark: SparkSession, d: str, what: str) -> str:
    """Writes the events table in the layout that a statement reads; the folder they are in."""
    f = paths.shared(spark, "files")
    events = spark.read.parquet(f"{d}/events.parquet")
    mixed = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), F.col("event_id") % 10, F.lit('"'))).when(F.col("event_id") % 3 == 1, (F.col("event_id") % 10).cast("string")).otherwise("null")
    head = F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.array("event_type", F.col("user_id").cast("string")).alias("tags")))
    line = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(', "props": '), F.col("props"), F.lit(', "mixed": '), F.col("m"), F.lit("}"))
    rows = events.select(head.alias("j"), "props", mixed.alias("m")).select(line.alias("value"))
    engine = Engine(spark)
    if "lines" in what:
        rows.write.text(f"{f}/lines")
    if "gzip" in what:
        rows.write.option("compression", "gzip").text(f"{f}/gzip")
    if "arrays" in what:
        rows.select(F.concat(F.lit("[[], "), "value", F.lit("]")).alias("value")).write.text(f"{f}/arrays")
    if "side" in what:
        rows.write.option("lineSep", " ").text(f"{f}/side")
    if "csv.csv" in what:
        spark_rows = events.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(', "q"'))).alias("note"))
        spark_rows.write.parquet(f"{f}/csv_rows")
        engine.sql(f"insert into csv '{f}/csv.csv' select event_id, user_id, event_type, note from parquet '{f}/csv_rows';")
    if "json.json" in what:
        engine.sql(f"insert into json '{f}/json.json' select event_id, event_type from parquet '{d}/events.parquet';")
    if "nul" in what:
        rows.select(F.regexp_replace("value", ", ", ",\0 ").alias("value")).write.text(f"{f}/nul")
    if "beside" in what:
        rows.write.text(f"{f}/beside/lines")
        rows.write.option("lineSep", " ").text(f"{f}/beside/side")
    if "swapped" in what:
        for i, (head, cells) in enumerate((("event_id,event_type", ("event_id", "event_type")), ("Event_Type,event_id", ("event_type", "event_id")))):
            own = events.where(F.col("event_id") % 2 == i).select(F.concat_ws(",", *cells).alias("value"))
            own.mapInArrow(_under(head), "value string").write.text(f"{f}/swapped/{i}")
    if "csvgz" in what:
        events.select(F.col("event_id").cast("string").alias("value")).mapInArrow(_under("event_id"), "value string").write.option("compression", "gzip").text(f"{f}/csvgz")
    if "many" in what:
        Engine(spark, single_file=False).sql(f"insert into csv '{f}/many' select event_id, event_type from parquet '{d}/events.parquet';")
    if "listed" in what:
        engine.sql(f"insert into json '{f}/listed/one.json' select r_name from parquet '{d}/region.parquet';")
    return f


def _under(header: str):
    """Puts a header above the lines of each part."""

    def parts(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return parts


def _over_files(text: str) -> Query:
    return lambda spark, d: Engine(spark).sql(text.replace("{f}", _events(spark, d, text)).replace("{d}", d))


def _rows(names: str, rows) -> str:
    """SQL of the rows as they are."""
    quoted = ", ".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t({names})"


def _describe(kind: str, where: str, tail: str = "") -> Query:
    return lambda spark, d: Engine(spark).sql(f"describe {kind} '{_events(spark, d, where)}/{where}'{tail};")


def _describe_table(spark: SparkSession, d: str) -> DataFrame:
    """The path, another each time, is left out."""
    return _describe("json", "lines", " as table")(spark, d).select(F.regexp_replace("table", "'.*'", "'events'").alias("table"))


def _explain(spark: SparkSession, d: str) -> DataFrame:
    """What the plan of the flagship query must say: a scan with its filter, partial sums, a sort."""
    plan = Engine(spark).sql("explain " + FLAGSHIP.replace("{d}", d))
    says = {"scan": "%FileScan parquet%", "pushed": "%PushedFilters:%GreaterThanOrEqual(l_discount,0.05)%", "partial": "%partial_sum(%", "sorted": "%Sort [%"}
    return plan.agg(*(F.expr(f"bool_or(plan like '{v}')").alias(k) for k, v in says.items()))


_EVENT_KINDS = (("event_id", "Int"), ("event_type", "String"), ("mixed", "Int OR String"), ("props", "Struct<{k=Int}>"), ("tags", "Array<String>"), ("user_id", "Int"), ("value", "Float"))
_EVENT_TABLE = ("CREATE TABLE 'events' (", "  event_id INTEGER,", "  event_type STRING,", "  mixed UNION<", "    INTEGER,", "    STRING", "  >,", "  props STRUCT<", "    k: INTEGER", "  >,", "  tags ARRAY<STRING>,", "  user_id INTEGER,", "  value NULL", ")")
_FILE_KINDS = (("path", "String"), ("name", "String"), ("parent", "String"), ("extension", "String"), ("last_modified", "String"), ("size", "Float"))
_CSV_KINDS = tuple((c, "String") for c in ("event_id", "user_id", "event_type", "note"))

# name: (query, the same in DuckDB's SQL)
OTHER: dict[str, tuple[Query, str]] = {
    "describe_json": (_describe("json", "lines"), _rows("column_name, column_type", _EVENT_KINDS)),
    "describe_csv": (_describe("csv", "csv.csv"), _rows("column_name, column_type", _CSV_KINDS)),
    "describe_dir": (_describe("dir", "listed"), _rows("column_name, column_type", _FILE_KINDS)),
    "describe_table": (_describe_table, _rows('"table"', [(x,) for x in _EVENT_TABLE])),
    "describe_parquet": (_statement("describe parquet '{d}/nation.parquet';"), _rows("column_name, column_type", [("n_nationkey", "Int"), ("n_name", "String"), ("n_regionkey", "Int")])),
    "explain_select": (_explain, "SELECT true AS scan, true AS pushed, true AS partial, true AS sorted"),
    "dummy_limit": (_statement("select foo, bar from json 'dummy://x' limit 25;"), "SELECT 4::BIGINT AS foo, (i % 10)::BIGINT AS bar FROM range(25) t(i)"),
}


def queries() -> dict[str, Query]:
    out = {k: _statement(s) for k, (s, _) in STATEMENTS.items()}
    out |= {k: _over_files(s) for k, (s, _) in FILE_STATEMENTS.items()}
    return out | {k: q for k, (q, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in (STATEMENTS | FILE_STATEMENTS | OTHER).items()}
