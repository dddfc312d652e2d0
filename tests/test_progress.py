"""Work is followed by its stages and ended by its tag."""

import threading
import time

import pytest

from scene_analytics.plans import cli
from scene_analytics.plans.progress import Job
from tests.test_batch import CONFIG, images


def slow(spark):
    def wait(batches):
        for b in batches:
            time.sleep(60)
            yield b

    return spark.range(8).repartition(4).mapInArrow(wait, "id long")


def test_running_work_is_seen_and_cancelled(spark):
    seen, job = [], Job(spark)

    def watch():
        for _ in range(300):
            seen.extend(job.stages())
            if seen:
                break
            time.sleep(0.1)
        job.cancel()

    watcher = threading.Thread(target=watch)
    began = time.monotonic()
    with job:
        watcher.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            slow(spark).collect()
    watcher.join()
    assert seen and all(s.tasks >= s.done >= 0 for s in seen) and job.cancelled and time.monotonic() - began < 50
    assert spark.range(10).count() == 10 and job.stages() == []


def test_a_cancelled_batch_stops(spark, tmp_path, capsys):
    for name in ("a_left", "b_left", "c_left"):
        images(tmp_path / "in" / name)
    (tmp_path / "c.yaml").write_text(CONFIG)
    a = cli.parser().parse_args(["batch", "--input-dir", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-c", str(tmp_path / "c.yaml"), "--no-vignetting"])
    with Job(spark) as job:
        assert cli.run_batch(spark, a, lambda done, n, name: job.cancel(), job) == 1
    said = capsys.readouterr().out
    assert "cancelled before" in said and "1 done, 2 failed" in said and [p.name for p in (tmp_path / "out").iterdir()] == ["a_left"]
