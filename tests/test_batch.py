"""The batch command: every recording below a folder, tallied."""

import numpy as np

from scene_analytics.plans import cli
from scene_analytics.sources import png

CONFIG = """
global: {variance_threshold: 50.0, frame_sample_count: 4}
cameras:
  left: {type: narrow}
  rear: {type: wide}
"""


def images(folder, n=4):
    rng = np.random.default_rng(1)
    folder.mkdir(parents=True)
    fixed = rng.integers(0, 255, (12, 32, 3))
    for i in range(n):
        f = rng.integers(0, 255, (24, 32, 3))
        f[12:] = fixed
        (folder / f"f{i}.png").write_bytes(png.png_bytes(f))


def test_batch_goes_on_and_tallies(spark, tmp_path, capsys):
    images(tmp_path / "in" / "day_rear_1")
    images(tmp_path / "in" / "deep" / "night")
    (tmp_path / "c.yaml").write_text(CONFIG)
    args = ["batch", "--input-dir", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-c", str(tmp_path / "c.yaml"), "--no-vignetting", "--verbose"]
    assert cli.main(args) == 0
    said = capsys.readouterr().out
    assert "day_rear_1: camera rear" in said and "night: camera left" in said and "2 done, 0 failed" in said
    assert (tmp_path / "out" / "day_rear_1" / "rear_mask.png").exists() and (tmp_path / "out" / "night" / "left_mask.png").exists()

    broken = tmp_path / "in" / "bad"
    broken.mkdir()
    (broken / "f0.png").write_bytes(b"no image")
    assert cli.main(args) == 1
    said = capsys.readouterr().out
    assert "bad failed" in said and "2 done, 1 failed" in said


def test_batch_without_recordings(spark, tmp_path, capsys):
    assert cli.main(["batch", "--input-dir", str(tmp_path / "none")]) == 1
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "note.txt").write_text("x")
    assert cli.main(["batch", "--input-dir", str(tmp_path / "empty")]) == 1
    assert "no folder of images and no video" in capsys.readouterr().out
