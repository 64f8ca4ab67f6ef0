"""Small graphs with results worked out by hand."""

from vertexloom.graph import PropertyGraph


def social(spark):
    v = spark.createDataFrame([(1, "Iris", 31), (2, "Jon", 19), (3, "Kim", 72), (4, "Lea", 44), (5, "Max", 58), (6, "Nia", 50)], "id long, name string, age int")
    e = spark.createDataFrame([(1, 2, 4), (2, 3, 1), (3, 1, 9), (4, 1, 2), (4, 3, 3), (5, 4, 6), (5, 6, 1), (6, 2, 5)], "src long, dst long, w int")
    return PropertyGraph(v, e)


def weighted(spark):
    v = spark.createDataFrame([(i + 1, c) for i, c in enumerate("pqrstuvw")], "id long, name string")
    e = [(1, 2, 3), (1, 3, 10), (2, 3, 4), (2, 4, 8), (3, 5, 2), (4, 5, 1), (4, 6, 7), (5, 6, 12), (6, 7, 5), (5, 7, 20), (1, 8, 30)]
    return PropertyGraph(v, spark.createDataFrame([(a, b, float(w)) for a, b, w in e], "src long, dst long, weight double"))


def edges_only(spark, pairs):
    return PropertyGraph.from_edges(spark.createDataFrame(pairs, "src long, dst long"))


# The points of two moons, two of them with a class.
MOONS = """
36.61557569798658 47.349355875039336
4.147805572508534 36.644809805476555
2.219296875193455 26.471484722027228
35.372741084472295 48.119307476433505
42.9498290308209 30.76267151393701
22.08242513055536 55.200910135584756
46.73854615372252 34.76924552137124
0.41648675404694635 31.576034142558434
38.67301673565425 44.46719634657654
44.985433577928816 31.80413672585385
46.36723790949303 -3.317939051175152
68.2242377931767 8.632703446333682
70.84930511545907 19.904948264799046
35.06331032632355 12.462055994634493
49.32667867398061 1.8311804642871046
40.336608184058385 -0.37050779028638914
39.011502843707866 -0.2227984576451405
61.82512646557987 -0.4838196674429298
51.82314073959989 -6.002718614977788
50.12504608816882 -1.0701398506404338
"""


def moons(spark):
    rows = [(i, {9: 0, 19: 1}.get(i), [float(x) for x in line.split()]) for i, line in enumerate(MOONS.split("\n")[1:-1])]
    return spark.createDataFrame(rows, "id long, class_num int, pos array<double>")
