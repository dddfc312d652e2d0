"""Work under a tag: what of it runs, as Spark's stages tell, and ending it from another thread."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Stage:
    stage: int
    name: str
    tasks: int
    done: int


@dataclass
class Job:
    """All Spark jobs that its thread starts between `with` and the end of the block carry the tag.

        with Job(spark) as job:
            run_batch(spark, args, job=job)

    Another thread may ask `stages()` or call `cancel()`, after which running jobs fail and work that looks at `cancelled` stops.
    """

    spark: SparkSession
    tag: str = field(default_factory=lambda: f"scene-analytics-{uuid.uuid4().hex}")
    _stop: threading.Event = field(default_factory=threading.Event)

    def __enter__(self) -> Job:
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def stages(self) -> list[Stage]:
        """The active stages of the tag's jobs, with how many of their tasks are done; none if nothing runs."""
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        active = set(self.spark.sparkContext.statusTracker().getActiveStageIds())
        found = {}
        for job in tracker.getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else ():
                told = tracker.getStageInfo(stage)
                if stage in active and told.isDefined():
                    s = told.get()
                    found[stage] = Stage(stage, s.name(), s.numTasks(), s.numCompletedTasks())
        return [found[s] for s in sorted(found)]
