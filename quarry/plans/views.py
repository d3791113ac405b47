"""Derived input views shared by the analytics operators.

Each view exists twice: as a DataFrame plan (what the engine runs) and as SQL
text (what the DuckDB oracle runs).  Both must stay semantically identical.

Join strategy: ``nation`` and ``region`` have a fixed size at every scale
(25 and 5 rows), so they are broadcast explicitly.  ``part``, ``supplier``,
``customer`` and ``orders`` grow with the data and carry no hint: Spark decides
by their measured bytes (spark.sql.autoBroadcastJoinThreshold, and AQE at run
time), and splits skewed sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table
from quarry.session import tune

# Unique total order of sales_fact rows (positional operators need one).
SALES_ORDER = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def supplier_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> (s_suppkey, r_name); nation/region are fixed-size dimensions."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey).select("n_nationkey", "r_regionkey", "r_name")
    out = sup.join(F.broadcast(geo), sup.s_nationkey == geo.n_nationkey).select("s_suppkey", "r_regionkey", "r_name")
    return out


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    sup = supplier_region(spark, sf_dir)
    j = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    q = F.col("l_quantity")
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").alias("date"),
        F.col("r_name").alias("region"),
        F.col("r_name").alias("location"),
        F.col("p_brand").alias("product"),
        F.col("p_type").alias("category"),
        q.alias("sales"),
        (F.col("l_extendedprice") / q).alias("price"),
        (F.col("p_retailprice") * 0.6).alias("cost"),
        (q * ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 31) / 10.0).alias("stock"),
        (q * (F.lit(0.9) + (F.col("l_orderkey") % 21) / 100.0)).alias("production"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("defect"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("promo"),
    )


SALES_FACT_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS date, r_name AS region, r_name AS location,
       p_brand AS product, p_type AS category, l_quantity AS sales,
       l_extendedprice / l_quantity AS price, p_retailprice * 0.6 AS cost,
       l_quantity * ((l_partkey*7 + l_suppkey*13 + l_linenumber) % 31) / 10.0 AS stock,
       l_quantity * (0.9 + (l_orderkey % 21) / 100.0) AS production,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS defect,
       CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS promo
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
     JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
"""


def sales_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales_fact at (month, region, product) grain: partial aggregation before the shuffle."""
    return (
        sales_fact(spark, sf_dir)
        .groupBy(F.trunc(F.to_date("date"), "month").cast("timestamp_ntz").alias("date"), "region", "product")
        .agg(F.sum("sales").alias("sales"), F.sum("stock").alias("stock"))
    )


SALES_MONTH_SQL = """
SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS date, region, product, SUM(sales) AS sales, SUM(stock) AS stock
FROM sales_fact GROUP BY 1, 2, 3
"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` seen as stored data points: dataset_id / row_index / timestamp / payload."""
    tune(spark)
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("dataset_id"),
        F.col("event_id").alias("row_index"),
        F.col("ts").alias("timestamp"),
        F.col("props").alias("payload"),
        (F.col("value") >= 20).alias("is_valid"),
        F.col("value"),
    )


EVENT_POINTS_SQL = """
SELECT event_type AS dataset_id, event_id AS row_index, ts AS "timestamp", props AS payload,
       value >= 20 AS is_valid, value
FROM events
"""


def transport_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F").select("l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    sup = supplier_region(spark, sf_dir)
    j = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    return j.groupBy(F.col("p_type").alias("problem"), F.col("r_name").alias("src")).agg(F.count("*").alias("qty"))


def transport_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "O").select("l_partkey", "l_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = (li.join(part, li.l_partkey == part.p_partkey)
         .join(orders, li.l_orderkey == orders.o_orderkey)
         .join(cust, orders.o_custkey == cust.c_custkey))
    return j.groupBy(F.col("p_type").alias("problem"), F.col("c_mktsegment").alias("dst")).agg(F.count("*").alias("qty"))


def transport_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit cost per (problem, src, dst).

    The grid is part types x regions x market segments.  Regions (a fixed
    5-row dimension) and the distinct segments are each one small list built by
    a one-row aggregate and exploded onto every distinct part type, so the plan
    has no join at all; its size is |types| x |regions| x |segments|.
    """
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("problem")).distinct()
    regions = table(spark, sf_dir, "region").agg(F.collect_list(F.struct("r_regionkey", "r_name"))).scalar()
    segments = (table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
                .agg(F.collect_list("c_mktsegment")).scalar())
    grid = types.withColumn("_r", F.explode(regions)).withColumn("dst", F.explode(segments))
    return grid.select(
        "problem", F.col("_r.r_name").alias("src"), "dst",
        ((F.col("_r.r_regionkey") * 7 + F.ascii("dst") * 3) % 17 + 1).cast("bigint").alias("unit_cost"),
    ).distinct()


TRANSPORT_SQL = {
    "transport_supply": """
SELECT p_type AS problem, r_name AS src, COUNT(*) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
 WHERE l_linestatus = 'F' GROUP BY p_type, r_name
""",
    "transport_demand": """
SELECT p_type AS problem, c_mktsegment AS dst, COUNT(*) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 WHERE l_linestatus = 'O' GROUP BY p_type, c_mktsegment
""",
    "transport_cost": """
SELECT DISTINCT p_type AS problem, r_name AS src, c_mktsegment AS dst,
       CAST((r_regionkey * 7 + ASCII(c_mktsegment) * 3) % 17 + 1 AS BIGINT) AS unit_cost
  FROM part CROSS JOIN region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) seg
""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the views it uses."""
    ctes = []
    for n in names:
        if n == "sales_fact":
            ctes.append(f"sales_fact AS ({SALES_FACT_SQL})")
        elif n == "sales_month":
            ctes.append(f"sales_month AS ({SALES_MONTH_SQL})")
        elif n == "raw_orders":
            ctes.append(f"raw_orders AS ({RAW_ORDERS_SQL})")
        elif n == "event_points":
            ctes.append(f"event_points AS ({EVENT_POINTS_SQL})")
        elif n in TRANSPORT_SQL:
            ctes.append(f"{n} AS ({TRANSPORT_SQL[n]})")
        else:
            raise ValueError(n)
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` rendered as an all-text upload (what a delimited file read yields).

    Messy on purpose: currency amounts, European-formatted amounts, percent
    strings, yes/no tokens, two date-like columns, blank strings, amounts and
    dates that are no such thing, and rows that are entirely empty (every field
    NULL, hence equal) for about 1 % of the orders.
    """
    tune(spark)
    o = table(spark, sf_dir, "orders")
    empty = (F.col("o_orderkey") % 101) == 0
    whole = F.floor("o_totalprice").cast("bigint")

    def blank_if_empty(c):
        return F.when(empty, F.lit(None).cast("string")).otherwise(c)

    cols = {
        "order_id": F.col("o_orderkey").cast("string"),
        "order_date": F.when(F.col("o_orderkey") % 53 == 0, "soon").otherwise(F.to_date("o_orderdate").cast("string")),
        "updated_at": F.when(F.col("o_orderkey") % 53 == 0, "soon").otherwise(F.concat(F.to_date("o_orderdate").cast("string"), F.lit(" 00:00:00"))),
        "status": F.col("o_orderstatus"),
        "priority": F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  ")).otherwise(F.col("o_orderpriority")),
        "total_price": F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("string")).otherwise(
            F.when(F.col("o_orderkey") % 37 == 0, "unknown").otherwise(F.concat(F.lit("$"), F.format_number(whole, 0)))),
        "total_eu": F.concat(F.regexp_replace(F.format_number(whole, 0), ",", "."), F.lit(",00")),
        "discount": F.concat((whole % 50).cast("string"), F.lit("%")),
        "is_final": F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no"),
        "customer": F.col("o_custkey").cast("string"),
    }
    return o.select(*[blank_if_empty(c).alias(n) for n, c in cols.items()])


RAW_ORDERS_SQL = """
SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS order_id,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS order_date,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 00:00:00' END AS updated_at,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'unknown'
            ELSE '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) END AS total_price,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL
            ELSE replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') || ',00' END AS total_eu,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 50 AS VARCHAR) || '%' END AS discount,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'yes' WHEN o_orderstatus = 'O' THEN 'no' END AS is_final,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer
FROM orders
"""
