import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays
from pyspark.sql import functions as F

from scene_analytics.functions import names
from scene_analytics.operators import cameras, captions, clusters, community, edits, filters, knn, leiden, masks, quality, sampling, temporal, vignetting
from scene_analytics.operators.errors import AnalysisError
from scene_analytics.plans import cli, curation, mask_jobs
from scene_analytics.sources import config, embeddings, frames, png
from scene_analytics.streaming import variance as streaming

MASK = arrays(np.int32, st.tuples(st.integers(1, 14), st.integers(1, 14)), elements=st.sampled_from([0, 255]))


def table(spark, a, camera="m"):
    return spark.createDataFrame([(camera, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(a)], "camera_id string, y int, x int, mask int")


def grid(df, shape, column="mask"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def slow_regions(a, diagonal):
    seen, out = np.zeros(a.shape, int), 0
    for start in zip(*np.nonzero(a), strict=True):
        if not seen[start]:
            out += 1
            todo = [start]
            seen[start] = out
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        p = y + dy, x + dx
                        if (diagonal or not dy or not dx) and 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and a[p] and not seen[p]:
                            seen[p] = out
                            todo.append(p)
    return seen


@settings(max_examples=150, deadline=None)
@given(MASK, st.booleans())
def test_regions(a, diagonal):
    got, want = masks.label_regions(a > 0, diagonal), slow_regions(a > 0, diagonal)
    assert len(set(zip(got.ravel().tolist(), want.ravel().tolist(), strict=True))) == len(np.unique(want)) == len(np.unique(got))


@settings(max_examples=100, deadline=None)
@given(MASK)
def test_morphology_laws(a):
    m = lambda op, x=a: filters.morphology_array(x, op, 5, 1)
    assert (m("open") <= a).all() and (m("close") >= a).all()
    assert (255 - m("dilate", 255 - a) == m("erode")).all()
    assert (filters.morphology_array(a, "other") == a).all()
    assert (masks.fill_holes_array(a) >= a).all() and (masks.remove_small_array(a, 3) <= a).all()


def test_kernel():
    assert filters.ellipse(5).tolist() == [0, 2, 2, 2, 0]
    assert filters.ellipse(15).tolist() == [0, 4, 5, 6, 6, 7, 7, 7, 7, 7, 6, 6, 5, 4, 0]


def test_gaussian_keeps_constants_and_reflects():
    assert np.allclose(filters.gaussian_array(np.full((5, 40), 3.0), 3), 3)
    a = np.zeros((1, 9))
    a[0, 0] = 1
    assert filters.gaussian_array(a, 1.0)[0, 0] > filters.gaussian_kernel(1.0)[4]


def test_window_and_group_morphology_agree(spark):
    a = np.where(np.random.default_rng(0).random((20, 24)) < 0.3, 255, 0)
    for op in ("dilate", "erode"):
        for k, shape in ((5, "ellipse"), (11, "rect"), (15, "ellipse")):
            want = filters.morphology_array(a, op, k, 1, shape)
            assert (grid(filters.morphology_window(table(spark, a), op, k, shape), a.shape) == want).all()
            assert (grid(filters.morphology(table(spark, a), op, k, 1, shape), a.shape) == want).all()


def test_area_at_the_limit_stays(spark):
    a = np.zeros((6, 8), int)
    a[1:3, 1:5] = 255
    a[4, 6] = a[5, 7] = 255
    assert (masks.remove_small_array(a, 8) > 0).sum() == 8 and (masks.remove_small_array(a, 2) > 0).sum() == 10


def test_temporal_errors_and_modes(spark):
    rows = [("c", f, y, x, 10 * f, 5, 5) for f in range(3) for y in range(2) for x in range(2)]
    df = spark.createDataFrame(rows, frames.PIXELS)
    assert temporal.analyze(df).count() == 4
    with pytest.raises(AnalysisError):
        temporal.analyze(df.limit(0))
    with pytest.raises(AnalysisError):
        temporal.analyze(df.unionByName(spark.createDataFrame([("c", 4, 2, 0, 1, 1, 1)], df.schema)))
    with pytest.raises(ValueError):
        temporal.variance(df, "hsv")
    v = temporal.variance(df, "bgr").first().variance
    assert abs(v - np.var([0, 10, 20]) / 3) < 1e-9
    assert temporal.adaptive_static_mask(temporal.variance(df), temporal.TemporalConfig(block_size=2)).count() == 4


def test_confidence_over_half_is_static(spark):
    df = spark.createDataFrame([("c", 0, i, v) for i, v in enumerate([0.0, 49.999, 50.0, 50.001, 1e9])], "camera_id string, y int, x int, variance double")
    rows = temporal.static_mask(df).join(temporal.confidence(df), ["camera_id", "y", "x"]).collect()
    assert all((r.confidence > 0.5) == (r.mask == 255) for r in rows)


def test_resize_constant_and_identity(spark):
    a = np.random.default_rng(1).integers(0, 255, (6, 8))
    df = table(spark, a).withColumnRenamed("mask", "v").withColumn("v", F.col("v").cast("double"))
    half = filters.resize(df, 0.5, ["camera_id"])
    want = a.reshape(3, 2, 4, 2).mean(axis=(1, 3))
    assert np.allclose(grid(half, (3, 4), "v"), want)
    assert np.allclose(grid(filters.resize(df, 1.0, ["camera_id"]), a.shape, "v"), a)


def test_vignetting_black_frame(spark):
    df = spark.createDataFrame([("c", y, x, 0.0) for y in range(10) for x in range(10)], "camera_id string, y int, x int, brightness double")
    assert abs(vignetting.radial_radius(df).first().radius - 0.995) < 1e-9
    assert vignetting.threshold_mask(df).where("mask = 255").count() == 100
    assert vignetting.edge_mask(df, 2).count() == 100


def test_overlay_union_hints_resize(spark):
    a = np.array([[0, 255], [255, 0]])
    px = spark.createDataFrame([("m", 0, y, x, 100, 100, 100) for y in range(2) for x in range(2)], frames.PIXELS)
    assert masks.overlay(px, table(spark, a), (255, 0, 0), 0.25).where("b = 138 and g = 75").count() == 2
    assert masks.overlay(px, table(spark, a), shown=False).where("b = 100").count() == 4
    assert masks.union(table(spark, a), table(spark, 255 - a)).where("mask = 255").count() == 4
    shape = spark.createDataFrame([("m", 4, 4)], "camera_id string, h int, w int")
    assert masks.resize_mask(table(spark, a), shape).count() == 16


def test_samplers(spark):
    for n, k in ((58, 50), (5, 10), (100, 7), (0, 4)):
        got = [r.frame_idx for r in sampling.uniform_indices(spark, n, k).orderBy("i").collect()]
        m = min(n, k)
        assert got == ([int(i * (n / m)) for i in range(m)] if m else [])
    clips = spark.createDataFrame([("a", 3), ("b", 100), ("c", 0)], "clip string, frame_count int")
    got = sampling.clip_indices(clips).orderBy("clip", "i").collect()
    assert [r.frame_idx for r in got if r.clip == "b"] == np.linspace(0, 99, 16, dtype=int).tolist() and not [r for r in got if r.clip == "c"]
    fr = spark.createDataFrame([("a", i, i == 4) for i in range(9)], "clip string, frame_idx int, failed boolean")
    assert [r.frame_idx for r in sampling.strided(fr, 2).orderBy("frame_idx").collect()] == [0, 2]
    assert sampling.strided(fr, 2, stop_at_failure=False).count() == 4
    assert sampling.random_frames(fr, 4, 1).count() == 4 and sampling.frame_at(fr, 77).count() == 0
    padded = sampling.pad_frames(fr.where("frame_idx < 3"), 6).orderBy("slot").collect()
    assert [(r.slot, r.frame_idx) for r in padded] == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2), (5, 2)]
    assert sampling.sample_frames(fr.drop("failed"), 3).count() == 3


def test_knn_ties_metrics_and_zero(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)] + [(100 + i, [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.array([np.float32(r[1]) for r in rows], float)
    ids = np.array([r[0] for r in rows])
    for blocks in (2048, 16):
        got = knn.top_k(df, 4, "euclidean", blocks).collect()
        assert len(got) == 4 * len(rows)
        by = {}
        for r in got:
            by.setdefault(r.src, []).append(r.distance)
        for i, d in by.items():
            all_d = np.sort(np.linalg.norm(v[ids == i] - v[ids != i], axis=1))[:4]
            assert np.allclose(sorted(d), all_d, atol=1e-6)
    assert knn.top_k(df.limit(3), 15).count() == 6
    with pytest.raises(AnalysisError):
        knn.top_k(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], df.schema))


def test_negative_edges_stay(spark):
    sims = spark.createDataFrame([(1, 2, -0.25), (2, 1, -0.25), (1, 3, 0.5), (3, 1, -0.5)], "src long, dst long, similarity double")
    got = {(r.src, r.dst): r.weight for r in knn.symmetric_edges(sims).collect()}
    assert got == {(1, 2): -0.5, (2, 1): -0.5}


def planted(groups=6, size=25, p_in=0.5, p_out=0.02, seed=0):
    rng = np.random.default_rng(seed)
    n = groups * size
    of = np.repeat(np.arange(groups), size)
    a = np.triu(rng.random((n, n)) < np.where(of[:, None] == of, p_in, p_out), 1)
    s, d = np.nonzero(a | a.T)
    return n, s, d, of


def test_leiden_finds_planted_groups_and_is_stable(spark):
    n, s, d, of = planted()
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(s, d, strict=True)], "src long, dst long, weight double")
    nodes = spark.range(n + 2).withColumnRenamed("id", "vec_id")
    labels = leiden.leiden(edges, nodes)
    again = leiden.leiden(edges.orderBy(F.rand(5)), nodes)
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, again.collect()))
    truth = spark.createDataFrame([(i, int(c)) for i, c in enumerate(of)], "vec_id long, label int")
    r = curation.quality(labels, truth).first()
    assert r.ari >= 0.95 and r.nmi >= 0.95
    assert labels.agg(F.countDistinct("cluster_id")).first()[0] == 8
    found = np.array([r.cluster_id for r in labels.orderBy("vec_id").collect()])[:n]
    assert community.modularity(n, s, d, np.ones(len(s)), found) >= community.modularity(n, s, d, np.ones(len(s)), of) - 0.01


def test_leiden_communities_are_connected():
    n, s, d, _ = planted(4, 20, 0.2, 0.05, 3)
    of = community.leiden_arrays(n, s, d, np.ones(len(s)))
    for c in np.unique(of):
        inside = np.flatnonzero(of == c)
        reach, todo = {int(inside[0])}, [int(inside[0])]
        while todo:
            v = todo.pop()
            for u in d[s == v]:
                if of[u] == c and int(u) not in reach:
                    reach.add(int(u))
                    todo.append(int(u))
        assert len(reach) == len(inside)


@pytest.mark.parametrize("truth,pred,ari,nmi", [([0, 0, 1, 1], [5, 5, 9, 9], 1, 1), ([0, 0, 0], [1, 1, 1], 1, 1), ([0, 1, 2], [2, 1, 0], 1, 1), ([0, 0, 1, 1], [0, 1, 0, 1], -0.5, 0)])
def test_agreement(spark, truth, pred, ari, nmi):
    t = quality.contingency(spark.createDataFrame(list(zip(truth, pred, strict=True)), "t int, p int"), "t", "p")
    assert abs(quality.adjusted_rand_index(t).first().ari - ari) < 1e-9
    assert abs(quality.normalized_mutual_information(t).first().nmi - nmi) < 1e-9


def test_clusters_tie_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 1.0], 2)], "vec_id long, embedding array<float>, cluster_id int")
    assert {r.cluster_id: r.representative_idx for r in clusters.representatives(clusters.distances(df)).collect()} == {1: 3, 2: 4}
    with pytest.raises(AnalysisError):
        curation.run_from_embeddings(df.limit(0).drop("cluster_id"))


def test_names(spark):
    got = spark.createDataFrame([("/a/N1234567-123456789012/b/CMR_GT_Frame",), ("/x/plain/",), ("v.MP4",)], "p string").select(names.session_name(F.col("p")).alias("n"), names.extension(F.col("p")).alias("e")).collect()
    assert [r.n for r in got] == ["N1234567-123456789012.mp4", "plain.mp4", "v.MP4.mp4"] and got[2].e == "mp4"


def test_config():
    cams, whole = config.parse(None)
    assert cams == [] and whole == ((1920, 1080), 100, 50.0, 5)
    with pytest.raises(config.ConfigError):
        config.parse("")
    cams, _ = config.parse("cameras: {a: {expected_ego_regions: [{name: h, hint_roi: [1, 2]}]}, b: }")
    assert cams[0][6] == [("h", "", 1, 2, 0, 0)] and cams[1][2:5] == ("narrow", (1920, 1080), False)


def test_cameras(spark):
    df = spark.createDataFrame([("a", 0, "wide", False), ("b", 1, "narrow", True)], "camera_id string, cfg_order int, type string, has_vignetting boolean")
    assert cameras.narrow(df).first().camera_id == "b"
    assert [r.wanted for r in cameras.vignetting_wanted(df, False).orderBy("camera_id").collect()] == [False, True]
    videos = spark.createDataFrame([("/x/b_a.mp4",), ("/b/z.mp4",)], "file_path string")
    assert {r.file_path: r.camera_id for r in cameras.match(videos, df).collect()} == {"/x/b_a.mp4": "a", "/b/z.mp4": None}


def test_edits(spark):
    ops = ["brush", "brush", "undo", "brush", "redo", "undo", "undo", "undo", "redo"]
    rows = [("m", i, op, 2, 2, 6, 2, 2, 255) for i, op in enumerate(ops)]
    log = spark.createDataFrame(rows, "mask_id string, seq int, op string, x1 int, y1 int, x2 int, y2 int, size int, value int")
    assert [r.seq for r in edits.live_edits(log).collect()] == [0]
    many = spark.createDataFrame([("m", i, "brush" if i < 60 else "undo", 0, 0, 0, 0, 2, 255) for i in range(160)], log.schema)
    assert edits.live_edits(many).count() == 60 - 49
    blank = table(spark, np.zeros((6, 9), int)).withColumnRenamed("camera_id", "mask_id")
    drawn = edits.apply_edits(blank, edits.live_edits(log)).where("mask = 255")
    assert drawn.where("y = 2").count() == 7 and drawn.count() == 7 + 2 * 5
    assert edits.latest(log, 3).count() == 3


def test_png_round_trip_and_jobs(spark, tmp_path):
    a = np.where(np.random.default_rng(2).random((40, 50)) < 0.5, 255, 0)
    png.write_masks(table(spark, a, "cam"), str(tmp_path / "out"))
    assert (grid(png.read_mask(spark, str(tmp_path / "out" / "cam_mask.png")), a.shape) == a).all()
    rng = np.random.default_rng(3)
    folder = tmp_path / "frames"
    folder.mkdir()
    fixed = rng.integers(0, 255, (16, 50, 3))
    for i in range(5):
        f = rng.integers(0, 255, (40, 50, 3))
        f[24:] = fixed
        (folder / f"f{i}.png").write_bytes(png.png_bytes(f))
    (folder / "broken.png").write_bytes(b"no image")
    (folder / "note.txt").write_text("x")
    seq = frames.open_source(spark, str(folder), True, camera_id="cam")
    assert [r.frame_idx for r in seq.orderBy("frame_idx").collect()] == list(range(5))
    px = frames.to_pixels(seq)
    assert px.where("frame_idx = 0 and y = 24 and x = 0").first()[4:] == tuple(int(v) for v in fixed[0, 0][::-1])
    assert cli.main(["mask", "-i", str(folder), "-o", str(tmp_path / "m"), "--camera", "cam", "--no-vignetting", "--save-intermediate", "-n", "5"]) == 0
    assert {p.name for p in (tmp_path / "m").iterdir()} >= {"frames_mask.png", "frames_static.png", "frames_confidence.png"}
    _, unknown = mask_jobs.batch(px, spark.createDataFrame([], config.SCHEMA))
    assert [r.camera_id for r in unknown.collect()] == ["cam"]
    files = frames.paths(spark, str(tmp_path))
    assert frames.image_files(spark, str(folder)).count() == 6
    assert frames.discover_videos(files).count() == 0
    with pytest.raises(ValueError):
        frames.open_source(spark, "x.txt", False)


def test_discovery(spark):
    files = spark.createDataFrame([(p,) for p in ("/a/x.mp4", "/a/y.MOV", "/a/z.avi", "/a/b/w.mkv", "/a/s/CMR_GT_Frame/1.JPG", "/a/s/CMR_GT_Frame/0.JPG", "/a/t/CMR_GT_Frame/1.jpg", "/a/t/CMR_GT_Frame/2.JPG")], "path string")
    assert frames.discover_videos(files).count() == 4
    assert [r.path for r in frames.discover_batch(files, "/a").collect()] == ["/a/x.mp4", "/a/z.avi"]
    assert frames.discover_frame_folders(files).count() == 2
    got = [(r.frame_dir[3], r.frame_idx, r.path[-5:]) for r in frames.frame_folder_images(files).orderBy("path").collect()]
    assert got == [("s", 0, "0.JPG"), ("s", 1, "1.JPG"), ("t", 0, "1.jpg")]


def test_decoder_and_encoder_errors(spark):
    videos = spark.createDataFrame([("a.mp4", bytearray(b"ok")), ("b.mp4", bytearray(b"bad"))], "path string, content binary")

    def decoder(content):
        if content == b"bad":
            raise ValueError("broken")
        yield 0, 0.0, 1, 1, b"\1\2\3"

    got = {r.path: (r.frame_idx, r.error) for r in frames.decode_videos(videos, decoder).collect()}
    assert got == {"a.mp4": (0, None), "b.mp4": (None, "broken")}
    with pytest.raises(RuntimeError):
        frames.decode_videos(videos, None)

    def load():
        return lambda row: np.array([[3.0, 0.0], [3.0, 8.0]]) if row[0] != "b.mp4" else 1 / 0

    clips = spark.createDataFrame([(1, "a.mp4"), (2, "b.mp4")], "vec_id long, path string")
    rows = {r.vec_id: r for r in embeddings.encode(clips, load, ["path"]).collect()}
    assert np.allclose(rows[1].embedding, [0.6, 0.8]) and rows[2].embedding is None and rows[2].error


def test_curation_run_and_report(spark, tmp_path):
    df = embeddings.synthetic(spark, n=400, dim=16, clusters=12, noise=0.02)
    result = curation.run_from_embeddings(df.select("vec_id", "embedding"))
    assert curation.quality(result.labels, df.select("vec_id", "label")).first().nmi > 0.8
    lines = [r.line for r in curation.summarize(result).collect()]
    assert any(x.startswith("Cluster 0") for x in lines)
    assert result.captions.where("caption like 'Cluster %'").count() == result.clusters.count()
    embeddings.save(df, str(tmp_path / "e"))
    assert cli.main(["curate", "--embeddings", str(tmp_path / "e"), "--output-dir", str(tmp_path / "o"), "--skip-clustering"]) == 0
    own = captions.caption_clusters(result.clusters, lambda c: c.select("cluster_id", F.lit("x").alias("caption")))
    assert own.where("caption = 'x'").count() == result.clusters.count()


def test_stream_equals_table(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("c", f, y, x, *(int(v) for v in rng.integers(0, 255, 3))) for f in range(4) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(rows, frames.PIXELS)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streaming.running_mask(streaming.stream_pixels(spark, str(tmp_path / "in")), 2000.0).writeStream.outputMode("complete").format("memory").queryName("masks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("masks").collect())) == sorted(map(tuple, temporal.static_mask(temporal.variance(df), 2000.0).collect()))


def test_resize_joins_no_pixels(spark):
    """A join on pixels was broadcast by a size that the planner took for small."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (9, 7)).astype(float)
    df = table(spark, a).withColumnRenamed("mask", "v")
    shape = spark.createDataFrame([("m", 4, 11)], "camera_id string, h int, w int")
    for found, (h, w) in ((filters.resize(df, 0.6, ["camera_id"]), (5, 4)), (filters.resize_to(df, shape, ["camera_id"]), (4, 11))):
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        want = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                sy, sx = (y + 0.5) * 9 / h - 0.5, (x + 0.5) * 7 / w - 0.5
                y0, x0 = int(np.floor(sy)), int(np.floor(sx))
                for i, p in ((y0, 1 - sy + y0), (y0 + 1, sy - y0)):
                    for j, q in ((x0, 1 - sx + x0), (x0 + 1, sx - x0)):
                        want[y, x] += a[min(max(i, 0), 8), min(max(j, 0), 6)] * p * q
        assert np.allclose(grid(found, want.shape, "v"), want)
