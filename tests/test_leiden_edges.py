"""Which edges a turn of moves takes to its lots."""

from pyspark.sql import functions as F

from scene_analytics.operators import leiden


def test_nodes_that_stay_bring_only_edges_inside_their_community(spark):
    n = 60
    ring = [(i, (i + by) % n) for i in range(n) for by in (1, 2)]
    edges = spark.createDataFrame([(a, b, 1.0) for x, y in ring for a, b in ((x, y), (y, x))], leiden.EDGES)
    labels = spark.createDataFrame([(i, 4.0, i // 6 * 6) for i in range(n)], "vec_id long, k double, label long")
    weighed = leiden._dealt(leiden._weighed(labels), "label", 3)
    of, came = {i: i // 6 for i in range(n)}, []
    for turn in (0, 1):
        rows = {(r.src, r.dst) for r in leiden._around(edges, weighed, turn, 3, 5).collect()}
        draw = {r.vec_id: r.draw for r in labels.select("vec_id", leiden._hash("vec_id", turn // 2, 5).alias("draw")).collect()}
        moves = {i for i in draw if (draw[i] >> 7) % 2 == turn % 2}
        assert rows == {(r.src, r.dst) for r in edges.collect() if r.src in moves or of[r.src] == of[r.dst]}
        came.append(len(rows))
    assert max(came) < 4 * n and leiden._around(edges, weighed.withColumn("lot", F.lit(0)), 0, 1, 5).count() == 4 * n
