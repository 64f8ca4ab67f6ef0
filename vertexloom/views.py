"""Graph views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, where: str = "true") -> PropertyGraph:
    """Customers and suppliers (id 1000000 + key); an edge has the quantity that a customer bought from a supplier."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.lit("customer").alias("kind"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("kind"))
    lines = table(spark, sf_dir, "lineitem").where(where)
    bought = lines.join(table(spark, sf_dir, "orders"), lines.l_orderkey == F.col("o_orderkey"))
    edges = bought.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(F.sum("l_quantity").alias("qty"))
    return PropertyGraph(customer.unionByName(supplier), edges)


#: The definition of the sparse trade graph: large lines at a high discount. Queries on it read all of that graph.
SPARSE = "l_quantity >= 49 and l_discount >= 0.09"


def nation_flow(spark: SparkSession, sf_dir: str, loops: bool = False) -> PropertyGraph:
    """Nations; an edge has the quantity that customers of one bought from suppliers of another."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sold = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    flows = sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = flows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("q").alias("weight"))
    return PropertyGraph(nation, edges if loops else edges.where("src <> dst"))


def nation_dag(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Flows to a larger key, which makes them a graph without cycles."""
    g = nation_flow(spark, sf_dir)
    return PropertyGraph(g.vertices, g.edges.where("src < dst"))


def copurchase(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts; an edge joins two parts of one order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = items.join(items.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst").distinct()
    return PropertyGraph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), pairs)


def user_flow(spark: SparkSession, sf_dir: str, kind: str = "purchase") -> PropertyGraph:
    """Users; an edge from the user of each event of a kind to the user of the day's next."""
    day = Window.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    edges = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst"), "event_id").where("dst is not null")
    return PropertyGraph(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct(), edges)


def points(spark: SparkSession, sf_dir: str, labelled: str = "vec_id % 10 = 9") -> DataFrame:
    """id, pos, class_num of the vectors; the class is known for one in ten."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pos"), F.expr(f"case when {labelled} then label end").alias("class_num"))


#: The same views as common table expressions.
SQL = {
    "trade_v": "select c_custkey as id, c_name as name, c_acctbal as bal, 'customer' as kind from customer union all select s_suppkey + 1000000, s_name, s_acctbal, 'supplier' from supplier",
    "trade_e": "select o_custkey as src, l_suppkey + 1000000 as dst, sum(l_quantity) as qty from lineitem join orders on l_orderkey = o_orderkey group by all",
    "sparse_e": f"select o_custkey as src, l_suppkey + 1000000 as dst, sum(l_quantity) as qty from lineitem join orders on l_orderkey = o_orderkey where {SPARSE} group by all",
    "nation_v": "select n_nationkey::bigint as id, n_name as name, n_regionkey as region from nation",
    "nation_e": "select c_nationkey::bigint as src, s_nationkey::bigint as dst, sum(l_quantity) as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by all",
    "part_v": "select p_partkey as id, p_name as name from part",
    "part_e": "select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey",
    "user_v": "select distinct user_id as id from events",
    "user_e": "select * from (select user_id as src, lead(user_id) over (partition by date_trunc('day', ts) order by ts, event_id) as dst, event_id from events where event_type = 'purchase') where dst is not null",
    "points": "select vec_id as id, embedding::double[] as pos, case when vec_id % 10 = 9 then label end as class_num from embeddings",
}
SQL["dag_e"] = f"select * from ({SQL['nation_e']}) where src < dst"


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL with the named views before the body, which may go on with more expressions."""
    return f"with {'recursive ' if recursive else ''}" + ", ".join(f"{n} as materialized ({SQL[n]})" for n in names.split()) + " " + body
