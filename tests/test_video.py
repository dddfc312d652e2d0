"""Headers of video files and the command lines that take folders and videos."""

import struct

import numpy as np
import pytest

from scene_analytics.plans import cli
from scene_analytics.sources import frames, png, video


def box(kind, *parts, long=False):
    data = b"".join(parts)
    return (struct.pack(">I4sQ", 1, kind, len(data) + 16) if long else struct.pack(">I4s", len(data) + 8, kind)) + data


def track(kind, runs, scale, lasts, w, h, version=0):
    mdhd = struct.pack(">B3x", version) + (struct.pack(">16xIQ", scale, lasts) if version else struct.pack(">8xII", scale, lasts)) + bytes(4)
    stts = struct.pack(">4xI", len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)
    return box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", w << 16, h << 16)), box(b"mdia", box(b"mdhd", mdhd), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", box(b"stbl", box(b"stts", stts)))))


def mp4(version=0, last=True):
    sound, picture = track(b"soun", [(99, 1)], 1, 1, 0, 0), track(b"vide", [(100, 512), (20, 512)], 15360, 61440, 1920, 1080, version)
    movie, data = box(b"moov", sound, picture), box(b"mdat", bytes(3000), long=True)
    return box(b"ftyp", b"isom") + (data + movie if last else movie + data)


def avi():
    return b"RIFF" + bytes(4) + b"AVI LIST" + bytes(4) + b"hdrlavih" + struct.pack("<I", 56) + struct.pack("<10I", 40_000, 0, 0, 0, 75, 0, 1, 0, 640, 480)


def test_metadata(spark, tmp_path):
    files = {"a.mp4": mp4(), "b.mov": mp4(1, False), "c.avi": avi(), "d.mp4": b"", "e.mp4": b"no video at all", "f.mp4": mp4()[:60], "g.mp4": box(b"ftyp", b"isom") + box(b"moov", track(b"vide", [], 0, 0, 8, 8))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in video.metadata(spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in files], "path string")).collect()}
    for name in ("a.mp4", "b.mov"):
        assert tuple(rows[name])[1:] == (120, 30.0, 1920, 1080, 4.0, None)
    assert tuple(rows["c.avi"])[1:] == (75, 25.0, 640, 480, 3.0, None)
    assert all(rows[n].error and rows[n].frame_count is None for n in ("d.mp4", "e.mp4", "f.mp4"))
    assert tuple(rows["g.mp4"])[1:] == (0, 0.0, 8, 8, 0.0, None)
    lost = video.metadata(spark.createDataFrame([(str(tmp_path / "none.mp4"),)], "path string")).first()
    assert lost.error and lost.duration is None
    assert video.metadata(spark.createDataFrame([], "path string")).count() == 0


def decoder(content):
    """Frames of a made-up video: its bytes say how many; half of each frame stands still."""
    rng = np.random.default_rng(7)
    still = rng.integers(0, 256, (10, 30, 3), np.uint8)
    if content == b"bad":
        raise ValueError("broken")
    for i in range(len(content)):
        yield i, 40.0 * i, 20, 30, np.concatenate([rng.integers(0, 256, (10, 30, 3), np.uint8), still]).tobytes()


def load_encoder():
    def encode(row):
        path, images = row
        if path.startswith("N0000002"):
            raise ValueError("broken")
        return np.array([1.0, float(len(images) if images is not None else len(path)), 2.0])

    return encode


def test_mask_of_a_video(spark, tmp_path, capsys):
    (tmp_path / "trip.mp4").write_bytes(b"0123")
    args = ["mask", "-i", str(tmp_path / "trip.mp4"), "-o", str(tmp_path / "o"), "--no-vignetting", "--verbose"]
    assert cli.main(args) == 1 and "no video decoder" in capsys.readouterr().out
    assert cli.main([*args, "--decoder", "tests.test_video:decoder", "--save-intermediate"]) == 0
    assert {p.name for p in (tmp_path / "o").iterdir() if p.suffix == ".png"} == {f"trip_{k}.png" for k in ("mask", "static", "vignetting", "confidence")} - {"trip_vignetting.png"}
    assert cli.main(["mask", "-i", str(tmp_path / "none"), "-o", str(tmp_path / "o")]) == 1


def test_batch_takes_videos(spark, tmp_path, capsys):
    (tmp_path / "one.mp4").write_bytes(b"012")
    (tmp_path / "two.avi").write_bytes(b"bad")
    (tmp_path / "THREE.MP4").write_bytes(b"012")
    heard = []
    a = cli.parser().parse_args(["batch", "--input-dir", str(tmp_path), "-o", str(tmp_path / "o"), "--no-vignetting", "--decoder", "tests.test_video:decoder"])
    assert cli.run_batch(spark, a, lambda *x: heard.append(x)) == 1
    assert "1 done, 1 failed" in capsys.readouterr().out and [h[:2] for h in heard] == [(1, 2), (2, 2)]
    assert (tmp_path / "o" / "one" / "one_mask.png").exists()


def test_curation_of_folders_and_videos(spark, tmp_path, capsys):
    for i in range(4):
        folder = tmp_path / "in" / "24.01w" / f"N000000{i}-123456789012" / "RAW_DB" / "x_CMR_1" / "CMR_GT_Frame"
        folder.mkdir(parents=True)
        for j in range(i + 1):
            (folder / f"{j}.jpg").write_bytes(b"x")
    base = ["curate", "--output-dir", str(tmp_path / "o"), "--encoder", "tests.test_video:load_encoder"]
    assert cli.main([*base, "--frame-dir", str(tmp_path / "in")]) == 0
    assert "3 encoded, 1 failed" in capsys.readouterr().out
    got = spark.read.parquet(str(tmp_path / "o" / "embeddings")).orderBy("vec_id").collect()
    assert [(r.vec_id, r.path[:8]) for r in got] == [(0, "N0000000"), (1, "N0000001"), (3, "N0000003")]
    assert abs(got[2].embedding[1] / got[2].embedding[0] - 4) < 1e-5
    assert cli.main([*base, "--frame-dir", str(tmp_path / "in"), "--frame-pattern", "*/other"]) == 1
    (tmp_path / "v" / "deep").mkdir(parents=True)
    (tmp_path / "v" / "deep" / "a.MKV").write_bytes(b"x")
    assert cli.main([*base, "--video-dir", str(tmp_path / "v")]) == 0
    assert cli.main(["curate", "--video-dir", str(tmp_path / "v")]) == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["curate"])


def test_patterns_of_folders(spark):
    files = spark.createDataFrame([(f"file:/d/{p}/1.jpg",) for p in ("a/F", "a/b/F", "a/b/G1", "F", "a+b/F/sub")], "path string")
    found = lambda *a: [r.frame_dir for r in frames.discover_frame_folders(files, *a).collect()]
    assert found("**/F", "file:/d") == ["file:/d/F", "file:/d/a+b/F", "file:/d/a/F", "file:/d/a/b/F"]
    assert found("*/F", "file:/d/") == ["file:/d/a+b/F", "file:/d/a/F"]
    assert found("a/b/G?", "file:/d") == ["file:/d/a/b/G1"] and found("*", "file:/d/a+b") == ["file:/d/a+b/F"] and found("x", "file:/d") == []


def test_masks_by_uri(spark, tmp_path):
    df = spark.createDataFrame([("c", y, x, 255 * (x % 2)) for y in range(3) for x in range(4)], "camera_id string, y int, x int, mask int")
    png.write_masks(df, f"file://{tmp_path}/deep/er")
    assert sorted(map(tuple, png.read_mask(spark, f"{tmp_path}/deep/er/c_mask.png", "c").collect())) == sorted(map(tuple, df.collect()))
