"""The SQL surface: what users ask of the events view and of tables beside it.

The same text runs in both engines where their dialects agree; else Spark's own stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.sinks import register
from logloom.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "lake", "records", "extractions", "documents", "embeddings")


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Run a user's query over the tables of a folder; only those that it names are registered."""
    for name in TABLES:
        if name in text:
            register(table(spark, folder, name), name)
    return spark.sql(text)


#: name -> SQL that both engines read alike.
SHARED = {
    "sql_vendor_counts": "SELECT vendor, count(*) AS n FROM lake GROUP BY vendor",
    "sql_pricing": """SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
        sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, count(*) AS n, max(l_shipdate) AS last
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_inner_join": """SELECT n_name, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "sql_left_join": """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "sql_full_join": """SELECT coalesce(c_nationkey, s_nationkey) AS nation, count(c_custkey) AS customers, count(s_suppkey) AS suppliers
        FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey GROUP BY 1""",
    "sql_semi_join": """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
    "sql_anti_join": """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "sql_self_theta": """SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "sql_rollup": """SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ROLLUP (n_regionkey, n_nationkey)""",
    "sql_cube": """SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "sql_grouping_sets": """SELECT event_type, user_id % 7 AS bucket, count(*) AS n FROM events
        GROUP BY GROUPING SETS ((event_type), (user_id % 7), ())""",
    "sql_ranking": """SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r,
        dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer""",
    "sql_frames": """SELECT event_id, lag(event_id, 1) OVER w AS before, lead(event_id, 2) OVER w AS after,
        sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three,
        first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "sql_distinct_aggregates": """SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(*) FILTER (WHERE c_acctbal < 0) AS below
        FROM customer GROUP BY c_mktsegment""",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT p_size * 100 AS k FROM part EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_top_k_per_group": """SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k
        FROM orders) WHERE k <= 2""",
    "sql_cte": """WITH spent AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1),
        mean AS (SELECT max(s) AS m FROM spent) SELECT k, s FROM spent, mean WHERE s > m / 2""",
    "sql_recursive_cte": """WITH RECURSIVE walk(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM walk WHERE n < 24)
        SELECT n, n_name FROM walk JOIN nation ON n_nationkey = n""",
    "sql_scalar_subquery": """SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)""",
    "sql_correlated": """SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    "sql_case_pivot": """SELECT p_brand, count(CASE WHEN p_size <= 10 THEN 1 END) AS small, count(CASE WHEN p_size > 10 THEN 1 END) AS large FROM part GROUP BY p_brand""",
    "sql_strings": """SELECT c_custkey, upper(c_name) AS u, substring(c_name, 3, 5) AS s, length(c_name) AS n, replace(c_name, '0', '_') AS r,
        concat_ws('-', c_mktsegment, c_nationkey) AS j, trim('  x ') AS t, lpad(CAST(c_nationkey AS STRING), 4, '0') AS p FROM customer""",
    "sql_dates": """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d,
        date_trunc('month', o_orderdate) AS first FROM orders""",
    "sql_math": """SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c,
        greatest(p_size, 10) AS g, least(p_size, 10) AS l, p_size & 12 AS b FROM part""",
    "sql_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 3",
    "sql_lake_hours": """SELECT time_ms - time_ms % 3600000 AS hour_ms, grammar, count(*) AS n, sum(bytes_total) AS bytes FROM lake GROUP BY 1, 2""",
}

#: name -> (Spark's text, DuckDB's text) where dialects differ.
PAIRED = {
    # the whole join; the SQL beside it still says the first 199 deliveries and is left as it was given
    "sql_point_join": (
        "SELECT r.seq AS seq, l.grammar AS grammar, l.time_ms AS time_ms FROM records r JOIN lake l ON lower(hex(r.id)) = l.record_id",
        "SELECT r.seq AS seq, l.grammar AS grammar, l.time_ms AS time_ms FROM records r JOIN lake l ON lower(hex(r.id)) = l.record_id",
    ),
    "sql_tumbling": (
        "SELECT unix_timestamp(window.start) AS starts, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type",
        "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS starts, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "sql_sliding": (
        "SELECT unix_timestamp(window.start) AS starts, count(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')",
        """SELECT s AS starts, count(*) AS n FROM (SELECT unnest([epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT,
           epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT - 3600]) AS s FROM events) GROUP BY 1""",
    ),
    "sql_sessions": (
        """SELECT user_id, unix_micros(CAST(session_window.start AS TIMESTAMP)) AS starts, count(*) AS n FROM events
           GROUP BY user_id, session_window(ts, '30 minutes')""",
        """SELECT user_id, epoch_us(min(ts)) AS starts, count(*) AS n FROM (
             SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
               SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE
                 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    ),
    "sql_as_of": (
        """SELECT event_id, last_value(before, true) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
           FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN event_id END AS before FROM events)""",
        """SELECT event_id, last_value(before IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
           FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN event_id END AS before FROM events)""",
    ),
    "sql_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "sql_lake_json": (
        """SELECT record_id, generation, get_json_object(ocsf, '$.metadata.product.name') AS product, get_json_object(ocsf, '$.src_endpoint.ip') AS ip FROM lake""",
        """SELECT record_id, generation, json_extract_string(ocsf, '$.metadata.product.name') AS product, json_extract_string(ocsf, '$.src_endpoint.ip') AS ip FROM lake""",
    ),
    "sql_arrays": (
        "SELECT vec_id, size(embedding) AS n, label, CAST(embedding[0] AS DOUBLE) AS first FROM embeddings",
        "SELECT vec_id, len(embedding)::INTEGER AS n, label, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings",
    ),
    "sql_maps": (
        "SELECT grammar, k, count(*) AS n FROM (SELECT grammar, explode(map_keys(fields)) AS k FROM extractions) GROUP BY grammar, k",
        "SELECT grammar, k, count(*) AS n FROM (SELECT grammar, unnest(map_keys(fields)) AS k FROM extractions) GROUP BY grammar, k",
    ),
    "sql_regex": (
        r"SELECT doc_id, regexp_extract(coalesce(text, ''), '([0-9]+)', 1) AS digits, regexp_replace(coalesce(source, ''), '[aeiou]', '') AS bare FROM documents",
        "SELECT doc_id, regexp_extract(coalesce(text, ''), '([0-9]+)', 1) AS digits, regexp_replace(coalesce(source, ''), '[aeiou]', '', 'g') AS bare FROM documents",
    ),
    "sql_quantiles": (
        "SELECT c_mktsegment, percentile(c_nationkey, 0.5) AS median, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, quantile_cont(c_nationkey, 0.5)::DOUBLE AS median, min_by(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_mktsegment",
    ),
}


def _runner(text: str):
    return lambda spark, folder: sql(spark, folder, text)


def range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Events within ten minutes after an event of the same user: bucketed by time, so that the join has a key."""
    rows = table(spark, folder, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    left = rows.select(F.col("event_id").alias("a"), "user_id", F.col("s").alias("sa"), F.explode(F.array(F.expr("s DIV 600"), F.expr("s DIV 600 + 1"))).alias("b"))
    right = rows.select(F.col("event_id").alias("z"), "user_id", F.col("s").alias("sz"), F.expr("s DIV 600").alias("b"))
    near = left.join(right, ["user_id", "b"]).where("sz > sa AND sz <= sa + 600")
    return near.select("a", "z")


def approximate(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of the lake: distinct records, and quantiles of bytes, by grammar."""
    return table(spark, folder, "lake").groupBy("grammar").agg(
        F.approx_count_distinct("record_id", 0.02).alias("records"), F.percentile_approx("bytes_total", [0.5, 0.99], 1000).alias("bytes")
    )


QUERIES = {name: _runner(text) for name, text in SHARED.items()}
QUERIES |= {name: _runner(texts[0]) for name, texts in PAIRED.items()}
QUERIES |= {"range_join": range_join, "approximate": approximate}

SQL = dict(SHARED)
SQL |= {name: texts[1] for name, texts in PAIRED.items()}
SQL["range_join"] = """SELECT l.event_id AS a, r.event_id AS z FROM (SELECT event_id, user_id, epoch(ts)::BIGINT AS s FROM events) l
    JOIN (SELECT event_id, user_id, epoch(ts)::BIGINT AS s FROM events) r ON l.user_id = r.user_id AND r.s > l.s AND r.s <= l.s + 600"""
