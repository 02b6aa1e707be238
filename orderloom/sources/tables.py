"""Table sources, and the order-management model over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2001-08-01"
#: Parts ordered at least this often count as popular.
POPULAR = 30


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, **options: str) -> DataFrame:
    """One table over JDBC; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (({"driver": driver} if driver else {}) | options).items():
        reader = reader.option(key, value)
    return reader.load()


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


class Model:
    """Lazily read logical tables; columns carry the names of the order-management domain."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return parquet(self.spark, self.dir, name)

    def customers(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as customer_id", "concat(c_name, ' ', c_mktsegment) as customer_name", "c_nationkey as nation_id", "c_acctbal as balance", "c_acctbal > 0 as customer_active"
        )

    def places(self) -> DataFrame:
        """nation is the country; for reports by city it is the city and its region the country."""
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_nationkey as nation_id", "n_name as country", "r_name as region")

    def vendors(self) -> DataFrame:
        return self.raw("supplier").selectExpr("s_suppkey as vendor_id", "s_name as vendor_name", "s_acctbal > 0 as vendor_active")

    def items(self) -> DataFrame:
        return self.raw("part").selectExpr("p_partkey as item_id", "p_name as item_name", "p_type as item_type", "p_brand as brand", "p_retailprice as item_price")

    def orders(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as order_id", "o_custkey as customer_id", "o_orderstatus as status", "o_totalprice as total_payment", "o_orderdate as date_of_order",
            "substr(cast(o_orderdate as string), 6, 2) as month", "o_orderstatus <> 'O' as is_processed",
        )

    def lines(self) -> DataFrame:
        """A returned or accepted line is rated; the rating comes from its discount."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey as order_id", "l_partkey as item_id", "l_suppkey as vendor_id", "l_linenumber as line", "l_quantity as quantity", "l_extendedprice as total_price",
            "case when l_returnflag <> 'N' then round(5 - 50 * l_discount, 2) end as line_rating",
        )


#: The same model for DuckDB.
MODEL_SQL = f"""
customers AS (SELECT c_custkey AS customer_id, c_name || ' ' || c_mktsegment AS customer_name, c_nationkey AS nation_id, c_acctbal AS balance, c_acctbal > 0 AS customer_active FROM customer),
places AS (SELECT n_nationkey AS nation_id, n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
vendors AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, s_acctbal > 0 AS vendor_active FROM supplier),
items AS (SELECT p_partkey AS item_id, p_name AS item_name, p_type AS item_type, p_brand AS brand, p_retailprice AS item_price FROM part),
sales AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS total_payment, o_orderdate AS date_of_order,
    substr(CAST(o_orderdate AS VARCHAR), 6, 2) AS month, o_orderstatus <> 'O' AS is_processed FROM orders),
lines AS (SELECT l_orderkey AS order_id, l_partkey AS item_id, l_suppkey AS vendor_id, l_linenumber AS line, l_quantity AS quantity, l_extendedprice AS total_price,
    CASE WHEN l_returnflag <> 'N' THEN round(5 - 50 * l_discount, 2) END AS line_rating FROM lineitem),
order_data AS (SELECT * FROM sales JOIN customers USING (customer_id) JOIN places USING (nation_id) JOIN lines USING (order_id) JOIN items USING (item_id) JOIN vendors USING (vendor_id) WHERE NOT is_processed),
all_lines AS (SELECT * FROM sales JOIN customers USING (customer_id) JOIN places USING (nation_id) JOIN lines USING (order_id) JOIN items USING (item_id) JOIN vendors USING (vendor_id)),
analytics_base AS (SELECT * FROM all_lines WHERE vendor_active
    AND total_payment >= 0.75 * (SELECT avg(total_payment) FROM sales WHERE lower(status) NOT IN ('cancelled', 'failed')) AND lower(status) NOT IN ('cancelled', 'failed')
    AND item_id IN (SELECT item_id FROM lines GROUP BY 1 HAVING count(*) >= {POPULAR}) AND customer_id IN (SELECT customer_id FROM sales GROUP BY 1 HAVING count(*) > 5)),
signups AS (SELECT customer_id, substr(CAST(min(date_of_order) AS VARCHAR), 6, 2) AS month FROM sales GROUP BY 1),
customer_sales AS (SELECT * FROM customers LEFT JOIN (SELECT customer_id, order_id, date_of_order FROM sales) USING (customer_id)),
sales_places AS (SELECT * FROM sales JOIN customers USING (customer_id) JOIN places USING (nation_id))
"""
