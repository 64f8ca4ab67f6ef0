import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tests.fixtures import edges_only, moons, social, weighted
from vertexloom import catalog
from vertexloom.algorithms import communities, neighbors, paths, ranking
from vertexloom.algorithms.components import connected_components
from vertexloom.algorithms.trees import minimum_spanning_forest
from vertexloom.graph import PropertyGraph
from vertexloom.ml import pipelines, recommend
from vertexloom.operators import structure
from vertexloom.plans.pregel import NotConverged, pregel
from vertexloom.sources import generators, gexf, readers


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_degrees_and_filters(spark):
    g = social(spark)
    assert as_dict(g.in_degrees()) == {1: 2, 2: 2, 3: 2, 4: 1, 6: 1}
    assert as_dict(g.out_degrees()) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1}
    assert as_dict(g.degrees()) == {1: 3, 2: 3, 3: 3, 4: 3, 5: 2, 6: 2}
    sub = g.subgraph(vertices="age >= 30")
    assert {r.id for r in sub.vertices.collect()} == {1, 3, 4, 5, 6}
    assert {(r.src, r.dst) for r in sub.edges.collect()} == {(3, 1), (4, 1), (4, 3), (5, 4), (5, 6)}
    assert g.subgraph(edges="w > 5").vertices.count() == 6
    assert {(r.src, r.dst) for r in g.subgraph(edges="w > 5").edges.collect()} == {(3, 1), (5, 4)}


def test_default_vertices_and_updates(spark):
    known = spark.createDataFrame([(3, "rxin"), (7, None)], "id long, name string")
    g = PropertyGraph.build(known, spark.createDataFrame([(3, 9)], "src long, dst long"), {"name": "John Doe"})
    assert as_dict(g.vertices) == {3: "rxin", 7: None, 9: "John Doe"}
    new = spark.createDataFrame([(3, None)], "id long, n string")
    assert as_dict(g.join_vertices(new, name="n").vertices) == {3: None, 7: None, 9: "John Doe"}


def test_oldest_follower(spark):
    best = social(spark).aggregate_messages(F.max(F.struct("age", "who", "name")).alias("m"), to_dst={"age": "src_age", "who": "src", "name": "src_name"}, dst=[])
    assert as_dict(best.select("id", "m.name")) == {1: "Kim", 2: "Nia", 3: "Lea", 4: "Max", 6: "Max"}


def test_remove_singletons_keeps_self_loops(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    g = PropertyGraph(v, spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long"))
    assert {r.id for r in g.remove_singletons().vertices.collect()} == {1, 2, 3}


def test_neighbor_ids(spark):
    g = social(spark)
    assert as_dict(g.neighbor_ids("out"))[5] == [4, 6]
    assert as_dict(g.neighbor_ids("in"))[5] == []
    with pytest.raises(ValueError):
        g.neighbor_ids("sideways")


def test_shortest_paths(spark):
    g = social(spark).map_edges(weight="w")
    assert as_dict(paths.shortest_paths(g, 5)) == {1: 8, 2: 6, 3: 7, 4: 6, 5: 0, 6: 1}
    w = weighted(spark)
    assert as_dict(paths.shortest_paths(w, 1)) == {1: 0, 2: 3, 3: 7, 4: 11, 5: 9, 6: 18, 7: 23, 8: 30}
    assert as_dict(paths.shortest_path_traces(w, 1).select("id", "path")) == {1: [], 2: [1], 3: [1, 2], 4: [1, 2], 5: [1, 2, 3], 6: [1, 2, 4], 7: [1, 2, 4, 6], 8: [1]}
    assert as_dict(paths.shortest_paths(w, 7, unreachable=-1.0))[1] == -1.0
    by_pregel = pregel(w, {"dist": F.when(F.col("id") == 1, 0.0)}, {"dist": "least(dist, offer)"}, [F.min("m").alias("offer")], to_dst={"m": "src_dist + weight"}, dst_if="src_dist + weight < coalesce(dst_dist, double('infinity'))", active="out")
    assert as_dict(by_pregel.vertices) == as_dict(paths.shortest_paths(w, 1))


def test_hops_and_counts(spark):
    g = edges_only(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (3, 5)])
    assert {(r.id, r.landmark): r.hops for r in paths.hops_to_landmarks(g, [3]).collect()} == {(1, 3): 2, (2, 3): 1, (3, 3): 0}
    assert as_dict(paths.propagate_edge_count(g)) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert as_dict(paths.max_hops(g, 20)) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    with pytest.raises(NotConverged):
        paths.max_hops(edges_only(spark, [(1, 2), (2, 1)]), 4)


def test_tour_and_forest(spark):
    visited, edges = paths.greedy_tour(weighted(spark), 1)
    assert as_dict(visited) == {i: i != 8 for i in range(1, 9)}
    assert {(r.src, r.dst) for r in edges.where("chosen").collect()} == {(1, 2), (2, 3), (3, 5), (4, 5), (4, 6), (6, 7)}
    tree = minimum_spanning_forest(weighted(spark)).collect()
    assert {(r.src, r.dst) for r in tree} == {(1, 2), (2, 3), (3, 5), (4, 5), (4, 6), (6, 7), (1, 8)} and sum(r.weight for r in tree) == 52
    two = PropertyGraph.from_edges(spark.createDataFrame([(1, 2, 1.0), (3, 4, 2.0), (4, 3, 1.0)], "src long, dst long, weight double"))
    assert {(r.src, r.dst) for r in minimum_spanning_forest(two).collect()} == {(1, 2), (4, 3)}


def test_components(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    g = PropertyGraph(v, spark.createDataFrame([(2, 5), (5, 3), (3, 2), (4, 5), (6, 7)], "src long, dst long"))
    assert as_dict(connected_components(g.edges)) == {2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 6}
    assert as_dict(communities.strong_components(g)) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 2, 6: 6, 7: 7}
    chain = connected_components(spark.range(300).selectExpr("id as src", "id + 1 as dst"))
    assert chain.where("component <> 0").count() == 0 and chain.count() == 301


def test_label_propagation(spark):
    g = edges_only(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (1, 3), (2, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 5), (5, 7), (6, 8)])
    assert as_dict(communities.label_propagation(g, 5)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5}


def test_triangles(spark):
    g = edges_only(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5), (5, 3)])
    assert as_dict(communities.triangles(g)) == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    row = communities.clustering_coefficient(g).first()
    assert (row.triangles, row.triplets) == (6, 10) and abs(row.coefficient - 0.6) < 1e-12
    assert as_dict(communities.bucketed_triangles(g, 3, 3)) == {0: 0, 1: 3, 2: 0}
    assert communities.clustering_coefficient(edges_only(spark, [(1, 2)])).first().coefficient == 0.0


SPAM_EDGES = [(1, 2), (2, 1), (1, 3)]


def test_ranks(spark):
    g = edges_only(spark, SPAM_EDGES)
    one = as_dict(ranking.pagerank_rounds(g, 1))
    assert abs(one[1] - 1.0) < 1e-12 and abs(one[2] - 0.575) < 1e-12
    many = as_dict(ranking.pagerank(g, tol=1e-9))
    assert abs(many[1] - (0.15 + 0.85 * many[2])) < 1e-6
    assert abs(sum(as_dict(ranking.pagerank_rounds(g, 3, normalize=True)).values()) - 3) < 1e-9
    own = as_dict(ranking.pagerank(g, tol=1e-9, source=3))
    assert own[1] == 0 and abs(own[3] - 0.15) < 1e-9


def test_neighbor_graphs(spark):
    p = moons(spark)
    exact = neighbors.knn_graph(p, 4)
    near = neighbors.knn_graph_banded(p, 4)
    a, b = {(r.src, r.dst) for r in exact.edges.collect()}, {(r.src, r.dst) for r in near.edges.collect()}
    assert len(a) == 80 and len(b) == 78 and b <= a
    labels = as_dict(neighbors.propagate_labels(near, max_rounds=10))
    assert labels == {i: int(i >= 10) for i in range(20)}
    row = neighbors.nearest_label(PropertyGraph(p.drop("class_num").join(spark.createDataFrame(list(labels.items()), "id long, class_num int"), "id"), near.edges).vertices, [30.0, 30.0]).first()
    assert row.class_num == 0 and row.id == 4 and abs(row.dist - 12.972268104139028) < 1e-9


def test_merge_and_keyed_table(spark):
    one = PropertyGraph(spark.createDataFrame([(1, "Aristotle"), (2, "Plato"), (3, "Socrates"), (4, "male")], "id long, attr string"), spark.createDataFrame([(2, 1, "x"), (3, 2, "x"), (3, 4, "g")], "src long, dst long, p string"))
    two = PropertyGraph(spark.createDataFrame([(1, "philosophers"), (2, "Aristotle"), (3, "Plato"), (4, "Socrates")], "id long, attr string"), spark.createDataFrame([(2, 1, "t"), (3, 1, "t"), (4, 1, "t")], "src long, dst long, p string"))
    merged = structure.merge_graphs(one, two)
    assert merged.vertices.count() == 5 and merged.edges.count() == 6
    base = structure.KeyedTable.of(spark.range(1000).selectExpr("id as k", "0 as v"))
    put = base.put(spark.createDataFrame([(123, 10873)], "k long, v int"))
    assert put.get(123).first().v == 10873 and base.get(123).first().v == 0
    assert put.inner_join(base, new=F.col("a.v")).where("new <> 0").collect()[0].k == 123
    assert put.delete(spark.createDataFrame([(998,), (999,)], "k long")).rows.count() == 998


def test_readers(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# comment\n3 1\n1\t2\n\n 2  3\n")
    g = readers.read_edge_list(spark, str(tmp_path / "edges.txt"), canonical=True, partitions=3)
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(1, 3), (1, 2), (2, 3)} and g.vertices.count() == 3
    (tmp_path / "a.feat").write_text("1 0 1\n2 1 0\n")
    assert as_dict(readers.read_first_feature(spark, str(tmp_path / "a.feat"))) == {1: False, 2: True}
    (tmp_path / "t.tsv").write_text("k\t<a>\t<p>\t<b>\nk\t<b>\t<p>\t<a>\nk\t<a>\t<p>\t<b>\n")
    rdf = readers.read_rdf(spark, str(tmp_path / "t.tsv"))
    assert as_dict(rdf.vertices) == {0: "<a>", 1: "<b>"} and rdf.edges.count() == 3
    (tmp_path / "d.csv").write_text("cat,dog,2.5\ndog,cow,1.5\n")
    tree = minimum_spanning_forest(readers.read_distances(spark, str(tmp_path / "d.csv")))
    assert tree.count() == 2


def test_egonets(spark, tmp_path):
    (tmp_path / "7.egonet").write_text("1: 2 3\n4: \n5:\n6: 5\n")
    (tmp_path / "8.egonet").write_text("1: 9\n")
    edges = readers.read_egonets(spark, str(tmp_path))
    lines = {r.UserId: r.Prediction for r in gexf.submission(structure.ego_circles(edges)).collect()}
    assert lines == {"7": "1 2 3;4;5 6", "8": "1 9"}


def test_gexf(spark):
    v = spark.createDataFrame([(1, 'a<"b"')], "id long, attr string")
    g = PropertyGraph(v, spark.createDataFrame([(1, 1, "x&y")], "src long, dst long, attr string"))
    text = gexf.to_gexf(g)
    assert '\t<node id="1" label="a&lt;&quot;b&quot;" />' in text and 'label="x&amp;y"' in text and text.endswith("</gexf>")
    viz = gexf.to_gexf(PropertyGraph(moons(spark), g.edges), scale=10.0)
    assert 'viz:position x="366.' in viz and viz.count("viz:color") == 2


def test_images(spark, tmp_path):
    rows = gexf.image_rows(spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "id long, cluster int"), 2)
    assert as_dict(rows) == {0: [1, 0], 1: [0, 1]}
    gexf.write_png(rows, str(tmp_path / "x.png"))
    image = readers.read_pixels(spark, str(tmp_path / "x.png"), shrink=1).orderBy("id").collect()
    assert [r.rgb for r in image] == [0xFFFFFF, 0, 0, 0xFFFFFF]


def test_generators(spark):
    assert generators.grid(spark, 4, 4).edges.count() == 24
    assert generators.star(spark, 8).edges.count() == 7
    a, b = generators.rmat(spark, 60, 100).edges.collect(), generators.rmat(spark, 60, 100).edges.collect()
    assert sorted(a) == sorted(b) and all(0 <= r.src < 64 and 0 <= r.dst < 64 for r in a)
    assert generators.log_normal(spark, 15).edges.where("dst < 0 or dst >= 15").count() == 0


def test_recommendations(spark):
    ratings = spark.createDataFrame([(1, 11, 5.0), (1, 12, 4.0), (2, 12, 5.0), (2, 13, 5.0), (3, 11, 5.0), (3, 13, 2.0), (4, 11, 4.0), (4, 12, 4.0)], "src long, dst long, rating double")
    model = recommend.svdpp(ratings)
    got = {(r.src, r.dst): r.score for r in recommend.predict(model, ratings.select("src", "dst")).collect()}
    error = sum((got[r.src, r.dst] - r.rating) ** 2 for r in ratings.collect()) / 8
    assert error < sum((4.25 - r.rating) ** 2 for r in ratings.collect()) / 8
    unknown = recommend.predict(model, spark.createDataFrame([(77, 88)], "src long, dst long")).first()
    assert unknown.score == model.mean


def test_recommendations_of_many_ratings(spark):
    ratings = spark.range(1000).selectExpr("id % 2 as src", "id div 2 as dst", "1.0 + (id * 7) % 5 as rating")
    got = recommend.predict(recommend.svdpp(ratings), ratings.select("src", "dst")).join(ratings, ["src", "dst"])
    error, spread = got.agg(F.avg((F.col("score") - F.col("rating")) ** 2), F.var_pop("rating")).first()
    assert error < spread


def test_predictions_of_all_supplied_parts(spark, tmp_path):
    lines = [(10, 1, 20.0), (10, 1, 40.0), (10, 7, 50.0), (11, 20, 10.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["svdpp_pred"](spark, str(tmp_path)).collect()
    assert {(r.src, r.dst) for r in got} == {(10, 1000001), (10, 1000007), (11, 1000020)}


def _user_tables(spark, tmp_path):
    """Purchases of one day, so that each is followed by the next; returns the edges."""
    users = [1, 2, 3, 1, 4, 5, 6, 5, 7]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(users)], "event_id long, user_id long")
    rows.selectExpr("event_id", "user_id", "'purchase' as event_type", "timestamp_seconds(1700000000 + event_id) as ts").write.parquet(str(tmp_path / "events.parquet"))
    return set(users), list(zip(users, users[1:], strict=False))


def _reach(ids, edges):
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a in ids:
            reach[a] |= {d for s, d in edges if s in reach[a]}
    return reach


def test_strong_components_and_circles_of_all_edges(spark, tmp_path):
    ids, edges = _user_tables(spark, tmp_path)
    reach = _reach(ids, edges)
    want = {a: min(b for b in ids if a in reach[b] and b in reach[a]) for a in ids}
    assert as_dict(catalog.QUERIES["scc"](spark, str(tmp_path))) == want
    lines = {}
    for ego in {s % 7 for s, _ in edges}:
        own = [(s, d) for s, d in edges if s % 7 == ego]
        reach = _reach({x for e in own for x in e}, own + [(d, s) for s, d in own])
        circles = sorted({tuple(sorted(r)) for r in reach.values()})
        lines[str(ego)] = ";".join(" ".join(map(str, c)) for c in circles)
    assert as_dict(catalog.QUERIES["ego_submission"](spark, str(tmp_path))) == lines


def test_depths_of_all_flows(spark, tmp_path):
    flows = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (4, 1)]
    tables = {
        "nation": ([(i, f"n{i}", 0) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, i) for i in range(5)], "c_custkey long, c_nationkey int"),
        "supplier": ([(i, i) for i in range(5)], "s_suppkey long, s_nationkey int"),
        "orders": ([(k, a) for k, (a, _) in enumerate(flows)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(k, b, 3.0 * k + 1) for k, (_, b) in enumerate(flows)], "l_orderkey long, l_suppkey long, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    assert as_dict(catalog.QUERIES["pregel_max_hops"](spark, str(tmp_path))) == want
    assert as_dict(catalog.QUERIES["propagate_edge_count"](spark, str(tmp_path))) == want


def test_depths_of_a_long_chain(spark):
    chain = edges_only(spark, [(i, i + 1) for i in range(26)])
    assert as_dict(paths.max_hops(chain, 30)) == {i: i for i in range(27)}


def test_triangles_of_buckets_past_the_least_number(spark):
    g = edges_only(spark, [(1, 2), (2, 3), (3, 1), (91, 92), (92, 93), (93, 91), (9, 10), (-1, 1)])
    assert as_dict(communities.bucketed_triangles(g, 10, 2)) == {0: 3, **dict.fromkeys(range(1, 9), 0), 9: 3}


def test_topics_train_on_all_terms(spark, tmp_path):
    words = [f"{a}{b}{c}rarely" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefg"]
    rows = [(i, " ".join(words[35 * i : 35 * (i + 1)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bags = readers.word_bags(docs)
    top, shares = pipelines.topics(bags, k=2, terms=700, rounds=2)
    assert {t for r in top.collect() for t in r.terms} == set(words)
    assert {r.doc_id for r in shares.collect() if abs(sum(r.topicDistribution) - 1) < 1e-9} == set(range(20))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.QUERIES["lda"](spark, str(tmp_path)).count() == 5


def test_pairs_of_all_points(spark, tmp_path):
    x = {i: float(i * 11 % 30) for i in range(40)}
    spark.createDataFrame([(i, [y, 0.0], 0) for i, y in x.items()], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["all_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in x for b in x if x[a] > x[b]}


def test_walks_and_ranks_that_do_not_end(spark):
    chain = PropertyGraph.from_edges(spark.createDataFrame([(1, 2, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double"))
    _, edges = paths.greedy_tour(chain, 1)
    assert edges.where("chosen").count() == 2 and edges.count() == 3  # of parallel edges one
    with pytest.raises(NotConverged):
        paths.greedy_tour(chain, 1, max_steps=1)
    with pytest.raises(NotConverged):
        ranking.pagerank(social(spark), tol=1e-12, max_rounds=2)


def test_put_of_repeated_keys(spark):
    table = structure.KeyedTable.of(spark.createDataFrame([(1, 5), (2, 6)], "k long, v int"))
    put = table.put(spark.createDataFrame([(1, 8), (1, 8), (3, 9)], "k long, v int"))
    assert sorted(map(tuple, put.rows.collect())) == [(1, 8), (2, 6), (3, 9)]


def test_nearest_points_of_coincident_points(spark, monkeypatch):
    """Ties, several blocks, positions of different lengths, and the point itself."""
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]
    points = spark.createDataFrame(rows, "id long, pos array<double>")
    want = {(a, b) for a, x in rows for _, b in sorted((abs(x[0] - y[0]), b) for b, y in rows if b != a)[:4]}
    assert {(r.src, r.dst) for r in neighbors.knn_graph(points, 4).edges.collect()} == want
    monkeypatch.setattr("vertexloom.algorithms.blocks.SENT_BYTES", 40)
    assert {(r.src, r.dst) for r in neighbors.knn_graph(points, 4).edges.collect()} == want
    mixed = points.unionByName(spark.createDataFrame([(20, [0.0])], "id long, pos array<double>"))
    assert neighbors.knn_graph(mixed, 4).edges.where("src = 20").count() == 4
    assert neighbors.knn_graph(points, 2, compat=True).edges.count() == 24 and neighbors.knn_graph(points.limit(0), 2).edges.count() == 0


def test_shared_folder_on_a_cluster():
    from vertexloom.plans.lineage import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_power_iteration_separates_two_cliques(spark):
    """Cliques of different sizes, since the start is by degree."""
    near = [(a + k, b + k, 1.0) for k, n in ((0, 4), (10, 12)) for a in range(n) for b in range(a + 1, n)] + [(0, 10, 0.01)]
    found = {r.id: r.cluster for r in pipelines.power_clusters(spark.createDataFrame(near, "src long, dst long, similarity double"), rounds=5).collect()}
    assert len({found[i] for i in range(4)}) == len({found[i] for i in range(10, 22)}) == 1 and found[0] != found[10]


def test_classifier_of_separable_rows(spark):
    rows = [(i, float(i >= 20), Vectors.dense(float(i), 1.0)) for i in range(40)]
    rows = spark.createDataFrame(rows, ["id", "label", "features"])
    assert pipelines.accuracy(rows, pipelines.fit_classifier(rows, 50)).first().accuracy == 100.0


def test_triangles_in_parts_without_rows_of_wedges(spark, monkeypatch):
    """Several parts, near and far corners, a hub; what is dealt out holds no wedges."""
    from itertools import combinations
    from random import Random

    from vertexloom.algorithms import corners

    dice = Random(5)
    pairs = {tuple(sorted(dice.sample(range(60), 2))) for _ in range(500)} | {(100, i) for i in range(60)} | {(k, k + j) for k in range(200, 290) for j in (1, 2)}
    links = {frozenset(p) for p in pairs}
    ids = sorted({i for p in pairs for i in p})
    found = [t for t in combinations(ids, 3) if all(frozenset(x) in links for x in combinations(t, 2))]
    want = {i: sum(i in t for t in found) for i in ids}
    g = edges_only(spark, sorted(pairs))
    for held in (corners.HELD, 150, 1):
        monkeypatch.setattr(corners, "HELD", held)
        assert as_dict(communities.triangles(g)) == want
    monkeypatch.setattr(corners, "STEP", 5)
    assert communities.clustering_coefficient(g).first().triangles == 3 * len(found)
    plan = communities.triangles(g)._jdf.queryExecution().toString()
    assert "gy" not in plan and "FlatMapGroupsInArrow" in plan


def test_similar_pairs_in_blocks(spark, monkeypatch):
    """Several blocks give the rows of a join of all pairs; one file of points is dealt out to all tasks."""
    from random import Random

    dice = Random(3)
    rows = [(i, [dice.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(200, [0.0] * 6), (201, [float("nan")] * 6)]
    points = spark.createDataFrame(rows, "id long, pos array<double>").coalesce(1)
    size = {i: sum(x * x for x in p) ** 0.5 for i, p in rows}
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    want = {(a, b) for a, p in rows for b, q in rows if a < b and a < 200 > b and dot(p, q) / size[a] / size[b] > 0.3}
    want |= {(i, 201) for i, _ in rows if i < 200}  # NaN is above all numbers
    for sent in (16 << 20, 900):
        monkeypatch.setattr("vertexloom.algorithms.blocks.SENT_BYTES", sent)
        got = pipelines.similarity_edges(points, 0.3, "pos")
        found = [(r.src, r.dst) for r in got.collect()]
        assert len(found) == len(set(found)) and {x for x in found if x != (200, 201)} == want
        assert got.rdd.getNumPartitions() > 1 and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_nearest_points_keep_few_candidates(monkeypatch):
    """Once a query has m points, only nearer ones are kept; ties, an offset and great lengths lose none."""
    import numpy as np

    from vertexloom.algorithms import blocks

    dice = np.random.default_rng(7)
    for scale, shift in ((1.0, 0.0), (1.0, 1e7), (1e25, 0.0), (0.0, 3.0)):
        q, x = dice.normal(size=(50, 4)) * scale + shift, np.round(dice.normal(size=(4000, 4)), 1) * scale + shift
        best, kept = blocks.Nearest(5, len(q)), 0
        for lo in range(0, len(x), 500):
            a, b, dist, best.within[:] = blocks.nearest_in(q, x[lo : lo + 500], 5, best.within.copy())
            best.add(a, lo + b, dist)
            kept += len(a)
            best.cut()
        got = np.stack(best.cut()[:2], 1).reshape(50, 5, 2)[:, :, 1]
        dist = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
        assert (got == np.lexsort((np.broadcast_to(np.arange(4000), dist.shape), dist))[:, :5]).all()
        assert kept < 1200 or scale != 1.0 or shift


def test_rank_ratio_of_one_run(spark, monkeypatch):
    steps, step = [], ranking._step
    monkeypatch.setattr(ranking, "_step", lambda *a: steps.append(1) or step(*a))
    g = edges_only(spark, SPAM_EDGES)
    got = as_dict(pipelines.rank_ratio(g, 5, 1))
    assert len(steps) == 5
    late, early = as_dict(ranking.pagerank_rounds(g, 5)), as_dict(ranking.pagerank_rounds(g, 1))
    assert got == {i: late[i] / early[i] for i in late}


def test_recommendation_rounds_are_compiled(spark, monkeypatch):
    """Rounds work on columns: no function over arrays is left in what they write."""
    plans, write = [], recommend.cut
    monkeypatch.setattr(recommend, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    ratings = spark.createDataFrame([(1, 11, 5.0), (1, 12, 4.0), (2, 12, 5.0)], "src long, dst long, rating double")
    recommend.svdpp(ratings, recommend.Settings(rounds=1))
    assert len(plans) > 4 and not any("lambda" in p for p in plans)


def test_ordered_pairs_repeat_in_files(spark, tmp_path):
    """Blocks of the least and of a greater size, ties, gaps; the file is far smaller than its ids."""
    rows = [(i, float(i * 7 % 50)) for i in range(300)] + [(300, None), (301, float("nan"))]
    points = spark.createDataFrame(rows, "id long, x double")
    above = lambda x, y: x is not None and y is not None and y == y and (x != x or x > y)
    want = {(a, b) for a, x in rows for b, y in rows if above(x, y)}
    for block in (1, 32, 4096):
        found = [(r.src, r.dst) for r in neighbors.ordered_pairs(points, block).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    spark.range(2000).selectExpr("id as vec_id", "array(cast(xxhash64(id) % 100000 as float)) as embedding", "0 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    catalog.QUERIES["all_pairs"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 600_000  # 2,000,000 rows or so, 1.4 bytes each in the order of a nested loop
