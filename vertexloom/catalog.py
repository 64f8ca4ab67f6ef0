"""The registered graph queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as v
from .algorithms import communities, neighbors, paths, ranking
from .algorithms.components import connected_components
from .algorithms.trees import minimum_spanning_forest
from .functions.vectors import cosine, java_hash, rgb
from .graph import PropertyGraph
from .ml import pipelines, recommend
from .operators import structure
from .plans.lineage import cut, shared_dir
from .plans.pregel import pregel
from .sources import generators, gexf, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- degrees, maps, restriction ------------------------------------------------


@query(v.with_views("trade_e", "select dst as id, count(*) as in_degree from trade_e group by 1"))
def degree_in(spark, d):
    return v.trade(spark, d).in_degrees()


@query(v.with_views("trade_e", "select src as id, count(*) as out_degree from trade_e group by 1"))
def degree_out(spark, d):
    return v.trade(spark, d).out_degrees()


@query(v.with_views("user_e", "select id, count(*) as degree from (select src as id from user_e union all select dst from user_e) group by 1"))
def degree_total(spark, d):
    return v.user_flow(spark, d).degrees()


@query(v.with_views("trade_v trade_e", "select v.id, name, bal, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree from trade_v v left join (select dst, count(*) n from trade_e group by 1) i on v.id = i.dst left join (select src, count(*) n from trade_e group by 1) o on v.id = o.src"))
def degree_join(spark, d):
    g = v.trade(spark, d)
    g = g.outer_join_vertices(g.in_degrees(), in_degree="coalesce(in_degree, 0)")
    return g.outer_join_vertices(g.out_degrees(), out_degree="coalesce(out_degree, 0)").vertices.select("id", "name", "bal", "in_degree", "out_degree")


@query(v.with_views("trade_e", "select src as id, count(*) as degree from trade_e group by 1 having count(*) > 30 order by degree desc, id"))
def degree_gt_sorted(spark, d):
    return v.trade(spark, d).out_degrees().where("out_degree > 30").orderBy(F.desc("out_degree"), "id").withColumnRenamed("out_degree", "degree")


@query(v.with_views("trade_v trade_e", "select id, name from trade_v join (select src, count(*) o from trade_e group by 1) on id = src where o % 2 = 0 and bal > 0"))
def vertex_filter(spark, d):
    g = v.trade(spark, d)
    return g.outer_join_vertices(g.out_degrees(), out_degree="out_degree").vertices.where("out_degree % 2 = 0 and bal > 0").select("id", "name")


@query(v.with_views("trade_e", "select src, dst, qty from trade_e where qty > 100"))
def edge_filter(spark, d):
    return v.trade(spark, d).edges.where("qty > 100")


@query(v.with_views("nation_v nation_e", "select src, dst, weight, s.name as src_name, t.name as dst_name from nation_e join nation_v s on src = s.id join nation_v t on dst = t.id where s.region <> t.region"))
def triplet_filter(spark, d):
    return v.nation_flow(spark, d).triplets().where("src_region <> dst_region").select("src", "dst", "weight", "src_name", "dst_name")


@query("select c_custkey as id, c_nationkey * 3 as tripled, (c_custkey * 2) // 17 as part from customer")
def map_vertices(spark, d):
    customers = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return PropertyGraph(customers, customers.select(F.col("id").alias("src"), F.col("id").alias("dst"))).map_vertices(tripled="c_nationkey * 3", part="(id * 2) div 17").vertices


@query(v.with_views("trade_e", "select src, dst, qty * 2 as doubled from trade_e"))
def map_edges(spark, d):
    return v.trade(spark, d).map_edges(doubled="qty * 2").edges


@query(v.with_views("nation_v nation_e", "select src, dst, s.name || '->' || t.name as label, contains(lower(s.name), 'a') as has_a, lower(s.name) = upper(t.name) as same from nation_e join nation_v s on src = s.id join nation_v t on dst = t.id"))
def map_triplets(spark, d):
    return v.nation_flow(spark, d).map_triplets(label="concat(src_name, '->', dst_name)", has_a="contains(lower(src_name), 'a')", same="lower(src_name) = upper(dst_name)").edges


@query(v.with_views("nation_v nation_e", "select src, dst, weight from nation_e where src in (select id from nation_v where region >= 2) and dst in (select id from nation_v where region >= 2)"))
def subgraph_v(spark, d):
    return v.nation_flow(spark, d).subgraph(vertices="region >= 2").edges.select("src", "dst", "weight")


@query(v.with_views("nation_v nation_e", "select id, name, (select count(*) from nation_e join nation_v s on src = s.id join nation_v t on dst = t.id where s.region = t.region and src = v.id) as kept from nation_v v"))
def subgraph_e(spark, d):
    g = v.nation_flow(spark, d).subgraph(edges="src_region = dst_region")
    return g.outer_join_vertices(g.out_degrees(), name="name", kept="coalesce(out_degree, 0)").vertices.select("id", "name", "kept")


@query(v.with_views("nation_v nation_e", "select src, dst from nation_e join nation_v s on src = s.id join nation_v t on dst = t.id where weight > 50 and s.region < 4 and t.region < 4"))
def subgraph_ve(spark, d):
    return v.nation_flow(spark, d).subgraph(vertices="region < 4", edges="weight > 50").edges.select("src", "dst")


@query(v.with_views("trade_v sparse_e", "select id, name from trade_v where id in (select src from sparse_e union all select dst from sparse_e)"))
def remove_singletons(spark, d):
    return v.trade(spark, d, v.SPARSE).remove_singletons().vertices.select("id", "name")


@query(v.with_views("sparse_e", "select id, coalesce(c_name, 'John Doe') as name, c_name is null as missing from (select src as id from sparse_e union select dst from sparse_e union select c_custkey from customer) left join customer on id = c_custkey"))
def default_vertex(spark, d):
    known = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(False).alias("missing"))
    return PropertyGraph.build(known, v.trade(spark, d, v.SPARSE).edges, {"name": "John Doe", "missing": True}).vertices


@query(v.with_views("trade_v trade_e", "select v.id, case when o.src is not null then o.q else bal end as bal from trade_v v left join (select src, max(qty) q from trade_e group by 1) o on v.id = o.src"))
def join_vertices(spark, d):
    g = v.trade(spark, d)
    most = g.edges.groupBy(F.col("src").alias("id")).agg(F.max("qty").alias("q"))
    return g.join_vertices(most, bal="q").vertices.select("id", "bal")


@query(v.with_views("trade_v trade_e", "select id, coalesce(q, 0.0) as bought from trade_v left join (select src, sum(qty) q from trade_e group by 1) on id = src"))
def outer_join_vertices(spark, d):
    g = v.trade(spark, d)
    return g.outer_join_vertices(g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("qty").alias("q")), bought="coalesce(q, 0.0D)").vertices.select("id", "bought")


@query(v.with_views("trade_v sparse_e", "select v.id, case when n is null then name || ' has no partner' else name || ' has ' || n || ' partners' end as label from trade_v v left join (select src, count(*) n from sparse_e group by 1) o on v.id = o.src"))
def left_join_label(spark, d):
    g = v.trade(spark, d, v.SPARSE)
    label = F.when(F.col("out_degree").isNull(), F.concat("name", F.lit(" has no partner"))).otherwise(F.concat("name", F.lit(" has "), F.col("out_degree").cast("string"), F.lit(" partners")))
    return g.outer_join_vertices(g.out_degrees(), label=label).vertices.select("id", "label")


@query(v.with_views("trade_e", "select distinct dst from trade_e where dst not in (select dst from trade_e where src = 1)"))
def anti_join_candidates(spark, d):
    edges = v.trade(spark, d).edges
    return edges.select("dst").distinct().join(edges.where("src = 1").select("dst"), "dst", "left_anti")


@query(v.with_views("nation_e", "select a.src, a.dst from nation_e a where not exists (select 1 from nation_e b where b.src = a.dst and b.dst = a.src and b.weight > a.weight)"))
def anti_join_pairs(spark, d):
    edges = v.nation_flow(spark, d).edges
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    heavier = edges.join(back, ["src", "dst"]).where("back > weight").select("src", "dst")
    return edges.select("src", "dst").join(heavier, ["src", "dst"], "left_anti")


@query(v.with_views("trade_v", "select count(*) as n, min(bal) as least, max(bal) as most, min(id) as first, max(id) as last from trade_v"))
def multi_extremes(spark, d):
    return v.trade(spark, d).vertices.agg(F.count("*").alias("n"), F.min("bal").alias("least"), F.max("bal").alias("most"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(v.with_views("user_e", "select least(src, dst) as src, greatest(src, dst) as dst, event_id from user_e"))
def canonical_edges(spark, d):
    return v.user_flow(spark, d).canonical().partition_edges(8).edges


@query(v.with_views("nation_v nation_e", "select id, count(n) as neighbors_n, coalesce(string_agg(n::varchar, ',' order by n), '') as neighbors from nation_v left join (select src, dst as n from nation_e where weight > 80) on id = src group by 1"))
def collect_neighbors_out(spark, d):
    return _neighbors(spark, d, "out")


@query(v.with_views("nation_v nation_e", "select id, count(n) as neighbors_n, coalesce(string_agg(n::varchar, ',' order by n), '') as neighbors from nation_v left join (select dst, src as n from nation_e where weight > 80) on id = dst group by 1"))
def collect_neighbors_in(spark, d):
    return _neighbors(spark, d, "in")


@query(v.with_views("nation_v nation_e", "select id, count(n) as neighbors_n, coalesce(string_agg(n::varchar, ',' order by n), '') as neighbors from nation_v left join (select src as i, dst as n from nation_e where weight > 80 union all select dst, src from nation_e where weight > 80) on id = i group by 1"))
def collect_neighbors_either(spark, d):
    return _neighbors(spark, d, "either")


def _neighbors(spark, d, direction):
    g = v.nation_flow(spark, d).subgraph(edges="weight > 80")
    return g.neighbor_ids(direction).select("id", F.size("neighbors").cast("long").alias("neighbors_n"), F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


# -- messages -----------------------------------------------------------------


@query(v.with_views("trade_v trade_e", "select id, count(*) as n, sum(round(bal * 100)::bigint)::bigint as cents, sum(round(bal * 100)::bigint)::bigint / count(*) as mean from (select case when s.bal > t.bal then dst else src end as id, case when s.bal > t.bal then s.bal else t.bal end as bal from trade_e join trade_v s on src = s.id join trade_v t on dst = t.id) group by 1"))
def agg_older_followers(spark, d):
    g = v.trade(spark, d)
    cents = F.round(F.col("bal") * 100).cast("long")
    return g.aggregate_messages(F.count("*").alias("n"), F.sum(cents).alias("cents"), (F.sum(cents) / F.count("*")).alias("mean"), to_dst={"bal": "src_bal"}, dst_if="src_bal > dst_bal", to_src={"bal": "dst_bal"}, src_if="not src_bal > dst_bal", src=["bal"], dst=["bal"])


@query(v.with_views("trade_v trade_e", "select dst as id, arg_max(s.name, {'b': bal, 'i': src}) as oldest, max(bal) as bal from trade_e join trade_v s on src = s.id group by 1"))
def agg_oldest_follower(spark, d):
    g = v.trade(spark, d)
    best = F.max(F.struct("bal", "who", "name")).alias("m")
    return g.aggregate_messages(best, to_dst={"bal": "src_bal", "who": "src", "name": "src_name"}, src=["bal", "name"], dst=[]).select("id", F.col("m.name").alias("oldest"), "m.bal")


@query(v.with_views("trade_e", "select src as id, count(*) as degree from trade_e group by 1 order by degree desc, id limit 1"))
def argmax_degree(spark, d):
    return structure.extreme(v.trade(spark, d).out_degrees().withColumnRenamed("out_degree", "degree"), "degree")


@query(v.with_views("trade_e", "select src as id, count(*) as degree from trade_e group by 1 order by degree, id limit 1"))
def argmin_degree(spark, d):
    return structure.extreme(v.trade(spark, d).out_degrees().withColumnRenamed("out_degree", "degree"), "degree", largest=False)


@query(v.with_views("trade_e", "select src as id, count(*) as degree from trade_e group by 1 order by degree desc, id limit 10"))
def top_ten(spark, d):
    return v.trade(spark, d).out_degrees().withColumnRenamed("out_degree", "degree").orderBy(F.desc("degree"), "id").limit(10)


# -- set operations, merging, keyed tables ---------------------------------------


_MERGED = """, a as (select src, dst, 1 as side from (select src, dst from nation_e where src % 2 = 0)), b as (select src, dst, 2 as side from nation_e where dst % 3 = 0),
ids as (select name, row_number() over (order by name) - 1 as id from (select distinct name from nation_v))
select i.id as src, j.id as dst, side from (select * from a union all select * from b) e join nation_v s on e.src = s.id join nation_v t on e.dst = t.id join ids i on s.name = i.name join ids j on t.name = j.name"""


@query(v.with_views("nation_v nation_e", _MERGED))
def merge_graphs(spark, d):
    g = v.nation_flow(spark, d)
    names = g.vertices.select("id", "name")
    one = PropertyGraph(names, g.edges.where("src % 2 = 0").select("src", "dst", F.lit(1).alias("side")))
    shifted = PropertyGraph(names.select((F.col("id") + 500).alias("id"), "name"), g.edges.where("dst % 3 = 0").select((F.col("src") + 500).alias("src"), (F.col("dst") + 500).alias("dst"), F.lit(2).alias("side")))
    return structure.merge_graphs(one, shifted, "name").edges


_TRIPLES = "select c_name as subject, 'lives_in' as predicate, n_name as object from customer join nation on c_nationkey = n_nationkey union all select n_name, 'part_of', r_name from nation join region on n_regionkey = r_regionkey"


def _triples(spark, d):
    nation = v.table(spark, d, "nation")
    lives = v.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subject"), F.lit("lives_in").alias("predicate"), F.col("n_name").alias("object"))
    part = nation.join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.col("r_name").alias("object"))
    return lives.unionByName(part)


@query(f"with t as ({_TRIPLES}), i as (select value, row_number() over (order by value) - 1 as id from (select subject as value from t union select object from t)) select a.id as src, b.id as dst, predicate from t join i a on subject = a.value join i b on object = b.value")
def rdf_encode(spark, d):
    return readers.encode(_triples(spark, d)).edges.select("src", "dst", "predicate")


@query(f"with t as ({_TRIPLES}) select value, row_number() over (order by value) - 1 as id from (select subject as value from t union select object from t)")
def dense_dictionary(spark, d):
    return readers.encode(_triples(spark, d)).vertices.select("value", "id")


def _keyed(spark, d):
    return structure.KeyedTable.of(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("value")), "k", 8)


@query("select o_orderkey as k, case when o_orderkey % 1000 = 7 then 10873 else 0 end as value from orders union all select -100, 111")
def indexed_put(spark, d):
    base = _keyed(spark, d)
    new = base.rows.where("k % 1000 = 7").select("k", F.lit(10873).alias("value")).unionByName(spark.createDataFrame([(-100, 111)], "k long, value int"))
    return base.put(new).rows


@query("select o_orderkey as k, 0 as value from orders where o_orderkey in (7, 1234, -5)")
def indexed_get(spark, d):
    return _keyed(spark, d).get(7, 1234, -5)


@query("select o_orderkey as k, 0 as value from orders where o_orderkey not in (998, 999)")
def indexed_delete(spark, d):
    return _keyed(spark, d).delete(spark.createDataFrame([(998,), (999,)], "k long")).rows


@query("select o_orderkey as k, 0 as before, 10873 as after from orders where o_orderkey % 1000 = 7")
def indexed_join(spark, d):
    base = _keyed(spark, d)
    put = base.put(base.rows.where("k % 1000 = 7").select("k", F.lit(10873).alias("value")))
    return base.inner_join(put, before=F.col("a.value"), after=F.col("b.value")).where("after <> 0")


# -- paths ----------------------------------------------------------------------


def _relax(rounds: int) -> str:
    steps = ["d0 as (select id, case when id = 0 then 0.0::double end as dist from nation_v)"]
    for k in range(rounds):
        steps.append(f"d{k + 1} as materialized (select d.id, least(d.dist, m.o) as dist from d{k} d left join (select dst, min(s.dist + weight) as o from d{k} s join nation_e on s.id = src group by 1) m on d.id = m.dst)")
    return ", " + ", ".join(steps) + f" select id, dist from d{rounds}"


@query(v.with_views("nation_v nation_e", _relax(24)))
def sssp_weighted(spark, d):
    return paths.shortest_paths(v.nation_flow(spark, d), 0)


def _trace(rounds: int) -> str:
    steps = ["t0 as (select 0::bigint as id, 0.0::double as dist, []::bigint[] as path)"]
    for k in range(rounds):
        steps.append(f"t{k + 1} as materialized (select id, m.dist, m.path from (select id, min(o) as m from (select id, {{'dist': dist, 'path': path}} as o from t{k} union all select dst, {{'dist': dist + weight, 'path': list_append(path, id)}} from t{k} join nation_e on id = src) group by 1))")
    return ", " + ", ".join(steps) + f" select v.id, dist, array_to_string(path, '>') as path from nation_v v left join t{rounds} t on v.id = t.id"


@query(v.with_views("nation_v nation_e", _trace(24)))
def sssp_trace(spark, d):
    out = paths.shortest_path_traces(v.nation_flow(spark, d), 0)
    return out.select("id", "dist", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(v.with_views("nation_v nation_e", _relax(24)))
def sssp_pregel(spark, d):
    out = pregel(v.nation_flow(spark, d), {"dist": F.when(F.col("id") == 0, 0.0)}, {"dist": "least(dist, offer)"}, [F.min("m").alias("offer")], to_dst={"m": "src_dist + weight"}, dst_if="src_dist + weight < coalesce(dst_dist, double('infinity'))", active="out")
    return out.vertices


@query(v.with_views("sparse_e", ", hop(id, landmark, hops) as (select l, l, 0::bigint from (values (1000003::bigint), (1000005), (1000008)) x(l) where l in (select src from sparse_e union select dst from sparse_e) union select u.n, h.landmark, h.hops + 1 from hop h join (select src as n, dst as at from sparse_e union select dst, src from sparse_e) u on u.at = h.id where h.hops < 40) select id, landmark, min(hops) as hops from hop group by 1, 2", recursive=True))
def hops_to_landmark(spark, d):
    g = v.trade(spark, d, v.SPARSE)
    both = g.edges.select("src", "dst").unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return paths.hops_to_landmarks(PropertyGraph.from_edges(both), [1000003, 1000005, 1000008])


_DEEPEST = ", deep(id, hops) as (select id, 0::bigint from nation_v union select dst, hops + 1 from deep join dag_e on id = src) select id, max(hops) as {} from deep group by 1"


@query(v.with_views("nation_v dag_e", _DEEPEST.format("hops"), recursive=True))
def pregel_max_hops(spark, d):
    return paths.max_hops(v.nation_dag(spark, d), 30)


@query(v.with_views("nation_v dag_e", _DEEPEST.format("count"), recursive=True))
def propagate_edge_count(spark, d):
    return paths.propagate_edge_count(v.nation_dag(spark, d))


_TOUR = """, walk(step, here, seen, src, dst) as (select 0, 0::bigint, [0::bigint], null::bigint, null::bigint union all
select step + 1, case when e.src = here then e.dst else e.src end, list_append(seen, case when e.src = here then e.dst else e.src end), e.src, e.dst from
(select step, here, seen, arg_min({'src': n.src, 'dst': n.dst}, {'w': weight, 's': n.src, 'd': n.dst}) as e from walk join nation_e n on (n.src = here and not list_contains(seen, n.dst)) or (n.dst = here and not list_contains(seen, n.src)) group by 1, 2, 3))
select src, dst, step - 1 as step from walk where step > 0"""


@query(v.with_views("nation_e", _TOUR, recursive=True))
def tsp_greedy(spark, d):
    return paths.greedy_tour(v.nation_flow(spark, d), 0)[1].where("chosen").select("src", "dst", "step")


def _tree() -> str:
    steps = ["r as materialized (select src, dst, weight, least(src, dst) as a, greatest(src, dst) as b, row_number() over (order by weight, src, dst) as r from nation_e)", "m0 as materialized (select a as x, b as y, min(r) as m from (select a, b, r from r union all select b, a, r from r) group by 1, 2)"]
    for k in range(5):
        steps.append(f"m{k + 1} as materialized (select x, y, min(m) as m from (select x, y, m from m{k} union all select p.x, q.y, greatest(p.m, q.m) from m{k} p join m{k} q on p.y = q.x and p.x <> q.y) group by 1, 2)")
    return ", " + ", ".join(steps) + " select src, dst, weight from r join m5 on a = x and b = y where r = m"


@query(v.with_views("nation_e", _tree()))
def mst(spark, d):
    return minimum_spanning_forest(v.nation_flow(spark, d))


# -- ranks ----------------------------------------------------------------------


def _ranks(rounds: int, init: float, source: int | None = None) -> str:
    first = f"{init}::double" if source is None else f"case when id = {source} then {init}::double else 0.0 end"
    base = "0.15" if source is None else f"case when v.id = {source} then 0.15 else 0.0 end"
    steps = ["o as (select src, count(*) as n from user_e group by 1)", f"r0 as (select id, {first} as rank from user_v)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} as materialized (select v.id, {base} + 0.85 * coalesce(g, 0.0) as rank from user_v v left join (select dst, sum(rank / n) as g from user_e join o using (src) join r{k} on src = id group by 1) s on v.id = s.dst)")
    return ", " + ", ".join(steps)


@query(v.with_views("user_v user_e", _ranks(1, 1.0) + " select id, round(rank, 6) as rank from r1"))
def pagerank_static_1(spark, d):
    return _rounded(ranking.pagerank_rounds(v.user_flow(spark, d), 1))


@query(v.with_views("user_v user_e", _ranks(5, 1.0) + " select id, round(rank, 6) as rank from r5"))
def pagerank_static_5(spark, d):
    return _rounded(ranking.pagerank_rounds(v.user_flow(spark, d), 5))


@query(v.with_views("user_v user_e", _ranks(5, 0.15) + " select r5.id, round(r5.rank / r1.rank, 6) as ratio from r5 join r1 using (id)"))
def pagerank_ratio(spark, d):
    return pipelines.rank_ratio(v.user_flow(spark, d), init=0.15).select("id", F.round("ratio", 6).alias("ratio"))


@query(v.with_views("user_v user_e", _ranks(90, 1.0) + " select id, round(rank, 4) as rank from r90"))
def pagerank_tol(spark, d):
    return ranking.pagerank(v.user_flow(spark, d), tol=1e-7).select("id", F.round("rank", 4).alias("rank"))


@query(v.with_views("user_v user_e", _ranks(40, 1.0, 1) + " select id, round(rank, 4) as rank from r40 where id <> 1 order by r40.rank desc, id limit 1"))
def ppr_argmax(spark, d):
    ranks = ranking.pagerank(v.user_flow(spark, d), tol=1e-7, source=1).where("id <> 1")
    return structure.extreme(ranks, "rank").select("id", F.round("rank", 4).alias("rank"))


def _rounded(ranks):
    return ranks.select("id", F.round("rank", 6).alias("rank"))


# -- components and communities ----------------------------------------------------


_CC = ", u as (select src, dst from sparse_e union select dst, src from sparse_e), reach(id, r) as (select src, src from u union select id, dst from reach join u on r = src)"


@query(v.with_views("sparse_e", _CC + " select id, min(r) as component from reach group by 1", recursive=True))
def cc(spark, d):
    return connected_components(v.trade(spark, d, v.SPARSE).edges)


@query(v.with_views("sparse_e", _CC + ", c as (select id, min(r) as component from reach group by 1) select component, string_agg(id::varchar, ',' order by id) as members from c group by 1", recursive=True))
def cc_members(spark, d):
    labels = connected_components(v.trade(spark, d, v.SPARSE).edges)
    return communities.component_members(labels).select("component", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(
    v.with_views(
        "user_v user_e",
        """, e as (select distinct src, dst from user_e),
        reach(id, r) as (select id, id from user_v union select id, dst from reach join e on r = src)
        select a.id, min(a.r) as component from reach a join reach b on a.id = b.r and a.r = b.id group by 1""",
        recursive=True,
    )
)
def scc(spark, d):
    return communities.strong_components(v.user_flow(spark, d))


@query(v.with_views("part_v part_e", ", t as (select x.src as a, x.dst as b, y.dst as c from part_e x join part_e y on x.dst = y.src join part_e z on z.src = x.src and z.dst = y.dst) select id, coalesce(n, 0) as triangles from part_v left join (select i, count(*) as n from (select a as i from t union all select b from t union all select c from t) group by 1) on id = i"))
def triangles(spark, d):
    return communities.triangles(v.copurchase(spark, d))


@query(v.with_views("part_e", ", t as (select x.src // 300 as bucket from part_e x join part_e y on x.dst = y.src join part_e z on z.src = x.src and z.dst = y.dst where x.src // 300 = y.dst // 300) select range as bucket, (3 * (select count(*) from t where bucket = range))::bigint as total from range((select max(p_partkey) // 300 + 1 from part))"))
def triangles_bucketed(spark, d):
    return communities.bucketed_triangles(v.copurchase(spark, d), 300, 1)


@query(v.with_views("part_e", ", t as (select count(*) * 3 as n from part_e x join part_e y on x.dst = y.src join part_e z on z.src = x.src and z.dst = y.dst), g as (select i, count(*) as g from (select src as i from part_e union all select dst from part_e) group by 1), p as (select sum(g * (g - 1) // 2)::bigint as p from g) select n::bigint as triangles, p as triplets, round(n / p, 9) as coefficient from t, p"))
def clustering_coefficient(spark, d):
    return communities.clustering_coefficient(v.copurchase(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


def _labels(rounds: int) -> str:
    steps = ["u as (select src as id, dst as n from user_e union all select dst, src from user_e)", "l0 as (select id, id as label from user_v)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} as materialized (select l.id, coalesce(w.label, l.label) as label from l{k} l left join (select id, label from (select u.id, label, row_number() over (partition by u.id order by count(*) desc, label) as r from u join l{k} m on u.n = m.id group by u.id, label) where r = 1) w on l.id = w.id)")
    return ", " + ", ".join(steps) + f" select id, label from l{rounds}"


@query(v.with_views("user_v user_e", _labels(5)))
def lpa5(spark, d):
    return communities.label_propagation(v.user_flow(spark, d), 5)


# -- neighbours -------------------------------------------------------------------


_DIST = "sqrt(list_sum([(p[i] - q[i]) * (p[i] - q[i]) for i in range(1, 65)]))"
_KNN = f"select src, dst, w from (select a.id as src, b.id as dst, 1 / (1 + dist) as w, row_number() over (partition by a.id order by dist, b.id) as r from (select a.id as aid, b.id as bid, {_DIST.replace('p[', 'a.pos[').replace('q[', 'b.pos[')} as dist from points a join points b on a.id <> b.id %s) x join points a on aid = a.id join points b on bid = b.id) where r <= 4"


@query(v.with_views("points", f"select src, dst, round(w, 6) as weight from ({_KNN % ''})"))
def knn_exact(spark, d):
    return neighbors.knn_graph(v.points(spark, d), 4).edges.select("src", "dst", F.round("weight", 6).alias("weight"))


def _banded() -> str:
    band = "floor((%s.pos[1] - lo) / (hi - lo) * 2 + {o})"
    one = _KNN % "join s on {a} = {b}"
    parts = [one.format(a=(band % "a").format(o=o), b=(band % "b").format(o=o)) for o in ("0.0", "0.5")]
    return ", s as (select min(pos[1]) as lo, max(pos[1]) as hi from points), e as (select * from (" + parts[0] + ") union select * from (" + parts[1] + ")) "


@query(v.with_views("points", _banded() + "select src, dst, round(w, 6) as weight from (select *, row_number() over (partition by src order by w desc, dst) as r from e) where r <= 4"))
def knn_approx(spark, d):
    return neighbors.knn_graph_banded(v.points(spark, d), 4).edges.select("src", "dst", F.round("weight", 6).alias("weight"))


def _spread(rounds: int) -> str:
    steps = ["e4 as materialized (select src, dst, w from (select *, row_number() over (partition by src order by w desc, dst) as r from e) where r <= 4)"]
    steps.append("u as materialized (select src as id, dst as n, w from e4 union all select dst, src, w from e4)")
    steps.append("l0 as (select id, class_num as label, id in (select src from e4) as fixed from points)")
    for k in range(rounds):
        best = f"select u.id, label, row_number() over (partition by u.id order by sum(w) desc, label) as r from u join l{k} m on u.n = m.id where label is not null group by u.id, label"
        steps.append(f"l{k + 1} as materialized (select l.id, case when (l.label is not null and fixed) or b.label is null then l.label else b.label end as label, fixed from l{k} l left join (select * from ({best}) where r = 1) b on l.id = b.id)")
    return ", " + ", ".join(steps) + f" select id, label as class_num from l{rounds}"


@query(v.with_views("points", _banded() + _spread(10)))
def ssl_lpa(spark, d):
    return neighbors.propagate_labels(neighbors.knn_graph_banded(v.points(spark, d), 4), max_rounds=10)


_AT = [round(0.01 * i, 2) for i in range(64)]


@query(v.with_views("points", f"select id, class_num, round(dist, 6) as dist from (select id, class_num, {_DIST.replace('p[i]', 'pos[i]').replace('q[i]', str(_AT) + '[i]')} as dist from points where class_num is not null) order by dist, id limit 1"))
def knn_predict(spark, d):
    return neighbors.nearest_label(v.points(spark, d), _AT).withColumn("dist", F.round("dist", 6))


@query(v.with_views("points", "select a.id as src, b.id as dst, round(list_sum([a.pos[i] * b.pos[i] for i in range(1, 65)]) / (sqrt(list_sum([x * x for x in a.pos])) * sqrt(list_sum([x * x for x in b.pos]))), 6) as similarity from points a join points b on a.id < b.id where list_sum([a.pos[i] * b.pos[i] for i in range(1, 65)]) / (sqrt(list_sum([x * x for x in a.pos])) * sqrt(list_sum([x * x for x in b.pos]))) > 0.3"))
def cosine_pairs(spark, d):
    return pipelines.similarity_edges(v.points(spark, d), 0.3, "pos").withColumn("similarity", F.round("similarity", 6))


# -- bags, export, functions ---------------------------------------------------------


_BAG = "select doc_id, lower(w) as term, count(*) as count from (select doc_id, unnest(string_split(text, ' ')) as w from documents) where length(w) > 5 and lower(w) <> 'reuter' group by 1, 2"


@query(_BAG)
def word_bag(spark, d):
    return readers.word_bags(v.table(spark, d, "documents"))


@query(f"select row_number() over (order by term) - 1 as id, term from (select distinct term from ({_BAG}))")
def vocab(spark, d):
    return pipelines.vocabulary(readers.word_bags(v.table(spark, d, "documents")))


@query(f"with b as ({_BAG}), i as (select row_number() over (order by term) - 1 as id, term from (select distinct term from b)) select doc_id, count(*) as terms, sum(id * count)::bigint as checksum from b join i using (term) group by 1")
def coded_bags(spark, d):
    bags = readers.word_bags(v.table(spark, d, "documents"))
    coded = pipelines.coded_bags(bags, pipelines.vocabulary(bags))
    return coded.select("doc_id", F.size("terms").cast("long").alias("terms"), F.aggregate(F.transform("terms", lambda t: t["id"] * t["count"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query(v.with_views("nation_v", "select id, chr(9) || '<node id=\"' || id || '\" label=\"' || name || '\" />' as line from nation_v"))
def gexf_nodes(spark, d):
    return gexf.gexf_nodes(v.nation_flow(spark, d), "name")


@query(v.with_views("nation_e", "select src, dst, '      <edge source=\"' || src || '\" target=\"' || dst || '\" label=\"' || weight::bigint || '\" />' as line from nation_e"))
def gexf_edges(spark, d):
    return gexf.gexf_edges(v.nation_flow(spark, d).map_edges(weight="cast(weight as bigint)"), "weight")


def _java_double(x: str) -> str:
    """SQL of a double as Java writes it: powers of ten below 1e-3 and from 1e7 on."""
    digits = "ltrim(replace(abs(x)::varchar, '.', ''), '0')"
    tiny = f"left({digits}, 1) || '.' || coalesce(nullif(substr({digits}, 2), ''), '0') || 'E-4'"
    mantissa, power = "split_part(abs(x)::varchar, 'e', 1)", "split_part(abs(x)::varchar, 'e', 2)::int"
    small = f"{mantissa} || case when contains({mantissa}, '.') then '' else '.0' end || 'E' || {power}"
    text = f"case when x = 0 or abs(x) >= 1e-3 then abs(x)::varchar when abs(x) >= 1e-4 then {tiny} else {small} end"
    return f"list_transform([{x}], lambda x: case when x < 0 then '-' else '' end || {text})[1]"


_COLOUR = "case class_num % 7 " + " ".join(f"when {k} then '{r}\" g=\"{g}\" b=\"{b}'" for k, (r, g, b) in enumerate(gexf.COLOURS)) + " end"


@query(
    v.with_views(
        "points",
        f"""select id, '      <node id="' || id || '" label="' || id || '">' || chr(10)
        || '        <viz:position x="' || {_java_double("pos[1] * 10")} || '" y="' || {_java_double("pos[2] * 10")} || '" />' || chr(10)
        || case when class_num is null then '' else '        <viz:color r="' || {_COLOUR} || '" />' || chr(10) end
        || '      </node>' as line from points""",
    )
)
def gexf_viz(spark, d):
    return gexf.gexf_viz_nodes(PropertyGraph(v.points(spark, d), v.points(spark, d).select(F.col("id").alias("src"), F.col("id").alias("dst"))), 10.0)


@query(
    v.with_views(
        "user_e",
        """, u as (select distinct src % 7 as ego, src, dst from user_e),
        b as (select ego, src, dst from u union select ego, dst, src from u),
        reach(ego, id, r) as (select ego, src, src from b union select reach.ego, id, dst from reach join b on reach.ego = b.ego and r = b.src),
        c as (select ego, id, min(r) as component from reach group by 1, 2),
        m as (select ego, component, string_agg(id::varchar, ' ' order by id) as t from c group by 1, 2)
        select ego::varchar as UserId, string_agg(t, ';' order by component) as Prediction from m group by 1""",
        recursive=True,
    )
)
def ego_submission(spark, d):
    edges = v.user_flow(spark, d).edges.select((F.col("src") % 7).cast("string").alias("ego"), "src", "dst")
    return gexf.submission(structure.ego_circles(edges))


@query("select n_nationkey as id, n_name as name, n_nationkey * 65793 + 513 as packed, (n_nationkey * 65793 + 513) >> 16 & 255 as r, (n_nationkey * 65793 + 513) >> 8 & 255 as g, (n_nationkey * 65793 + 513) & 255 as b from nation")
def rgb_unpack(spark, d):
    rows = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.expr("n_nationkey * 65793 + 513").alias("packed")).withColumn("c", rgb("packed"))
    return rows.select("id", "name", "packed", *[F.col("c")[i].cast("int").alias(c) for i, c in enumerate("rgb")])


def _java_hash_sql() -> str:
    step = "(h * 31 + ascii(substr(n_name, {k}, 1))) % 4294967296"
    inner = "select n_name, 0::bigint as h from nation"
    for k in range(1, 21):
        inner = f"select n_name, case when length(n_name) >= {k} then {step.format(k=k)} else h end as h from ({inner})"
    return f"select n_name as name, case when h >= 2147483648 then h - 4294967296 else h end as hash from ({inner})"


@query(_java_hash_sql())
def string_hash(spark, d):
    return v.table(spark, d, "nation").select(F.col("n_name").alias("name"), java_hash("n_name").alias("hash"))


@query("select i as id, i // 6 as row, i % 6 as col, (case when i % 6 < 5 then 1 else 0 end + case when i // 6 < 4 then 1 else 0 end)::bigint as out_degree from range(30) t(i)")
def grid_graph(spark, d):
    g = generators.grid(spark, 5, 6)
    return g.outer_join_vertices(g.out_degrees(), row="row", col="col", out_degree="coalesce(out_degree, 0)").vertices.select("id", "row", "col", "out_degree")


@query("select i as src, 0::bigint as dst from range(1, 8) t(i)")
def star_graph(spark, d):
    return generators.star(spark, 8).edges.select("src", "dst")


@query()
def rmat_graph(spark, d):
    return generators.rmat(spark, 60, 200).edges


@query()
def log_normal_graph(spark, d):
    return generators.log_normal(spark, 40).out_degrees()


@query("select c_custkey as id, 0 as value from customer")
def checkpointed_iteration(spark, d):
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("value"))
    g = PropertyGraph(rows, rows.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    return structure.iterate_state(g, 6, lambda vertices, edges: vertices.select("id", F.expr("cast((value * 1) div 17 as int)").alias("value")), every=3)


# -- files: tables written as text to the shared folder and read back ---------------------


def _written(spark, lines: DataFrame, name: str, **options) -> str:
    """The path of a new text file of the lines (one string column) in the shared folder."""
    path = f"{shared_dir(spark)}/vertexloom-files-{uuid.uuid4().hex}/{name}"
    lines.write.options(**options).text(path)
    return path


def _edge_lines(spark, d):
    lines = v.user_flow(spark, d).edges.select(F.concat_ws(" \t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return lines.unionByName(spark.createDataFrame([("# src dst",), ("  ",)], "value string"))


@query(v.with_views("user_e", "select src, dst, 1 as attr from user_e"))
def edge_list_file(spark, d):
    return readers.read_edge_list(spark, _written(spark, _edge_lines(spark, d), "edges.txt")).edges


@query(v.with_views("user_e", "select least(src, dst) as src, greatest(src, dst) as dst, 1 as attr from user_e"))
def edge_list_canonical(spark, d):
    return readers.read_edge_list(spark, _written(spark, _edge_lines(spark, d), "edges.txt"), canonical=True, partitions=4).edges


@query(v.with_views("user_e", "select distinct id, 1 as attr from (select src as id from user_e union all select dst from user_e)"))
def edge_list_vertices(spark, d):
    return readers.read_edge_list(spark, _written(spark, _edge_lines(spark, d), "edges.txt")).vertices


@query("select c_custkey::bigint as id, c_nationkey % 2 = 1 as feature from customer")
def feature_file(spark, d):
    lines = v.table(spark, d, "customer").select(F.concat_ws(" ", F.col("c_custkey").cast("string"), (F.col("c_nationkey") % 2).cast("string"), F.lit("7")).alias("value"))
    return readers.read_first_feature(spark, _written(spark, lines, "features.txt"))


def _distances(spark, d) -> PropertyGraph:
    g = v.nation_flow(spark, d)
    names = g.triplets(["name"], ["name"])
    lines = names.select(F.concat_ws(",", "src_name", "dst_name", F.col("weight").cast("string")).alias("value"))
    return readers.read_distances(spark, _written(spark, lines, "distances.csv"))


_NAMED = """, i as (select name, row_number() over (order by name) - 1 as id from nation_v where id in (select src from nation_e union all select dst from nation_e)),
named_e as materialized (
  select a.id as src, b.id as dst, weight
  from nation_e join nation_v s on src = s.id join nation_v t on dst = t.id join i a on a.name = s.name join i b on b.name = t.name)"""


@query(v.with_views("nation_v nation_e", _NAMED + " select src, dst, weight from named_e"))
def distances_file(spark, d):
    return _distances(spark, d).edges.select("src", "dst", "weight")


@query(v.with_views("nation_v nation_e", _NAMED + " select id, name from i"))
def distances_vertices(spark, d):
    return _distances(spark, d).vertices


@query(v.with_views("nation_v nation_e", _NAMED + _tree().replace("nation_e", "named_e").replace("select src, dst, weight from r join", ", q as (select src, dst, weight from r join") + """)
  select src, dst, '      <edge source="' || src || '" target="' || dst || '" label="' || weight::bigint || '" />' as line from q"""))
def distances_to_tree(spark, d):
    """Distances from a file, their spanning tree, and the tree's GEXF lines."""
    g = _distances(spark, d)
    tree = minimum_spanning_forest(g)
    return gexf.gexf_edges(PropertyGraph(g.vertices, tree.withColumn("weight", F.col("weight").cast("long"))), "weight")


@query(f"with t as ({_TRIPLES}), i as (select value, row_number() over (order by value) - 1 as id from (select subject as value from t union select object from t)) select a.id as src, b.id as dst, predicate from t join i a on subject = a.value join i b on object = b.value")
def rdf_file(spark, d):
    lines = _triples(spark, d).select(F.concat_ws("\t", F.lit("k"), "subject", "predicate", "object").alias("value"))
    return readers.read_rdf(spark, _written(spark, lines, "facts.tsv")).edges.select("src", "dst", "predicate")


@query(v.with_views("user_e", "select (src % 7)::varchar as ego, src, dst from user_e union all select 'NO MATCH', 5, 5"))
def egonet_files(spark, d):
    """One folder for each ego, named by it; a vertex without neighbours and a file without a number."""
    edges = v.user_flow(spark, d).edges.select(F.concat((F.col("src") % 7).cast("string"), F.lit(".egonet")).alias("file"), "src", "dst")
    others = F.array_join(F.collect_list(F.col("dst").cast("string")), " ")
    lines = edges.groupBy("file", "src").agg(others.alias("others")).select("file", F.concat(F.col("src").cast("string"), F.lit(": "), "others").alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("plain", "5:")], "file string, value string"))
    path = f"{shared_dir(spark)}/vertexloom-files-{uuid.uuid4().hex}/nets"
    lines.write.partitionBy("file").text(path)
    return readers.read_egonets(spark, path)


def _gexf_sql(name: str) -> str:
    values = ", ".join("('" + line.replace("'", "''") + "')" for part in (gexf.HEAD % "", gexf.MIDDLE, gexf.TAIL) for line in part.rstrip("\n").split("\n"))
    return f"select line from ({ORACLES['gexf_nodes']}) union all select line from ({ORACLES['gexf_edges']}) union all select * from (values {values}) t({name})"


@query(_gexf_sql("line"))
def gexf_file(spark, d):
    """The whole document, written as one file and read back."""
    path = f"{shared_dir(spark)}/vertexloom-files-{uuid.uuid4().hex}/graph.gexf"
    gexf.write_gexf(v.nation_flow(spark, d).map_edges(weight="cast(weight as bigint)"), path, vertex_label="name", edge_label="weight")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("select ((p_partkey - 1) // 40)::bigint as row, string_agg((p_size % 2)::varchar, '' order by p_partkey) as pixels from part group by 1")
def image_rows(spark, d):
    clusters = v.table(spark, d, "part").select((F.col("p_partkey").cast("long") - 1).alias("id"), (F.col("p_size") % 2).alias("cluster"))
    return gexf.image_rows(clusters, 40).select("row", F.array_join(F.transform("pixels", lambda x: x.cast("string")), "").alias("pixels"))


# -- models -------------------------------------------------------------------------


@query()
def lda(spark, d):
    top, _ = pipelines.topics(readers.word_bags(v.table(spark, d, "documents")))
    return top.select("topic", F.array_join("terms", " ").alias("terms"))


@query()
def pic(spark, d):
    return pipelines.power_clusters(pipelines.similarity_edges(v.points(spark, d), 0.3, "pos"))


def _augmented(spark, d):
    g = v.trade(spark, d)
    g = PropertyGraph(g.vertices, cut(g.edges.select("src", "dst")))  # read by the degrees and the ranks
    g = g.outer_join_vertices(g.degrees(), bal="bal", degree="coalesce(degree, 0)", label="case when kind = 'supplier' then 1 else 0 end")
    return pipelines.augment(g, pipelines.rank_ratio(g, init=0.15), ["bal", "degree"], "label")


@query(
    v.with_views(
        "trade_v trade_e",
        _ranks(5, 0.15).replace("user_", "trade_")
        + """, g as (select id, count(*) as degree from (select src as id from trade_e union all select dst from trade_e) group by 1)
        select v.id, (case when kind = 'supplier' then 1 else 0 end)::double as label, bal, coalesce(degree, 0)::double as degree, round(r5.rank / r1.rank, 6) as ratio
        from trade_v v join r5 on v.id = r5.id join r1 on v.id = r1.id left join g on v.id = g.id""",
    )
)
def augmented_rows(spark, d):
    rows = _augmented(spark, d).withColumn("x", vector_to_array("features"))
    return rows.select("id", F.col("label").cast("double").alias("label"), F.col("x")[0].alias("bal"), F.col("x")[1].alias("degree"), F.round(F.col("x")[2], 6).alias("ratio"))


@query()
def logreg_accuracy(spark, d):
    rows = cut(_augmented(spark, d))  # each round of the fit reads them
    return pipelines.accuracy(rows, pipelines.fit_classifier(rows))


def _ratings(spark, d):
    return v.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).agg((F.avg("l_quantity") / 10).alias("rating"))


def _svdpp(rounds: int) -> str:
    """SQL of the rounds of SVD++ over `e` (src, dst, rating): `score`, and the model u<rounds>, i<rounds>, c<rounds>."""
    s = recommend.Settings(rounds=rounds)
    dims = range(s.rank)
    each = lambda form, sep=", ": sep.join(form.format(k=k) for k in dims)

    def seeded(name: str, salt: int) -> str:
        head = f"('0x' || substr(md5(id || ':{{k}}:{s.seed}:{salt}'), 1, 8))::bigint"
        return each(f"({head} / 2147483648.0::double - 1) * 0.5 as {name}{{k}}")

    def step(gamma: float) -> str:
        return f"least({gamma}::double, 0.5::double / n)"

    def contexts(r: int) -> str:
        sums = each("sum(y{k}) as s{k}")
        return f"""c{r} as materialized (select u.*, {each("p{k} + s{k} * norm as c{k}")}
        from u{r} u join (select src, {sums} from e join i{r} i on dst = i.id group by 1) on src = u.id)"""

    sql = f"""mean as materialized (select avg(rating) as m from e),
    u0 as materialized (select *, {seeded("p", 1)} from
        (select src as id, avg(rating) - any_value(m) as bias, 1 / sqrt(count(*)) as norm from e, mean group by 1)),
    i0 as materialized (select *, {seeded("q", 2)}, {seeded("y", 3)} from
        (select dst as id, avg(rating) - any_value(m) as bias from e, mean group by 1)),
    {contexts(0)}"""
    for r in range(rounds):
        guess = f"m + c.bias + i.bias + {each('q{k} * c{k}', ' + ')}"
        sql += f""",
    r{r} as materialized (select *, {each(f"err * q{{k}} - {s.lambda7} * p{{k}} as dp{{k}}")},
            {each(f"err * c{{k}} - {s.lambda7} * q{{k}} as dq{{k}}")}, {each(f"err * norm * q{{k}} - {s.lambda7} * y{{k}} as dy{{k}}")},
            err - {s.lambda6} * bu as du, err - {s.lambda6} * bi as di
        from (select src, dst, c.bias as bu, i.bias as bi, norm, {each("p{k}, c{k}, q{k}, y{k}")},
                rating - least({s.most}::double, greatest({s.least}::double, {guess})) as err
            from e join c{r} c on src = c.id join i{r} i on dst = i.id, mean)),
    u{r + 1} as materialized (select id, bias + {step(s.gamma1)} * du as bias, norm, {each(f"p{{k}} + {step(s.gamma2)} * dp{{k}} as p{{k}}")}
        from u{r} join (select src, count(*) as n, sum(du) as du, {each("sum(dp{k}) as dp{k}")} from r{r} group by 1) on src = id),
    i{r + 1} as materialized (select id, bias + {step(s.gamma1)} * di as bias, {each(f"q{{k}} + {step(s.gamma2)} * dq{{k}} as q{{k}}")},
            {each(f"y{{k}} + {step(s.gamma2)} * dy{{k}} as y{{k}}")}
        from i{r} join (select dst, count(*) as n, sum(di) as di, {each("sum(dq{k}) as dq{k}, sum(dy{k}) as dy{k}")} from r{r} group by 1) on dst = id),
    {contexts(r + 1)}"""
    return sql


#: The score of a pair of `c` (a user's context) and `i` (an item).
_SCORE = "round(m + c.bias + i.bias + " + " + ".join(f"q{k} * c{k}" for k in range(recommend.Settings().rank)) + ", 6)"


@query(
    f"""with e as materialized (select l_suppkey as src, l_partkey + 1000000 as dst, avg(l_quantity) / 10 as rating from lineitem group by 1, 2),
    {_svdpp(4)}
    select src, dst, {_SCORE} as score from e join c4 c on src = c.id join i4 i on dst = i.id, mean"""
)
def svdpp_pred(spark, d):
    edges = cut(_ratings(spark, d))
    scored = recommend.predict(recommend.svdpp(edges, recommend.Settings(rounds=4)), edges.select("src", "dst"))
    return scored.withColumn("score", F.round("score", 6))


@query(
    f"""with t as ({_TRIPLES}), lives as (select * from t where predicate = 'lives_in'),
    ids as materialized (select value, row_number() over (order by value) - 1 as id
        from (select subject as value from lives union select object from lives)),
    e as materialized (select a.id as src, b.id as dst, 1.0::double as rating from lives join ids a on subject = a.value join ids b on object = b.value),
    {_svdpp(2)}
    select i.id as dst, value, {_SCORE} as score from c2 c, i2 i join ids on ids.id = i.id, mean
    where c.id = (select id from ids where value = 'Customer#000000001') and i.id not in (select dst from e where src = c.id)
    order by m + c.bias + i.bias + {" + ".join(f"q{k} * c{k}" for k in range(recommend.Settings().rank))} desc, i.id limit 1"""
)
def missing_link(spark, d):
    graph = readers.encode(_triples(spark, d).where("predicate = 'lives_in'"))
    found = recommend.missing_link(graph, "lives_in", "Customer#000000001", recommend.Settings(rounds=2))
    return found.withColumn("score", F.round("score", 6))


@query(v.with_views("points", "select a.id as src, b.id as dst from points a, points b where a.id <> b.id and a.pos[1] > b.pos[1]"))
def all_pairs(spark, d):
    return neighbors.ordered_pairs(v.points(spark, d).select("id", F.col("pos")[0].alias("x")))


__all__ = ["ORACLES", "QUERIES", "cosine"]
