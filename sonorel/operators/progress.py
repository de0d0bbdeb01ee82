"""Progress of a running extraction, or of any other action, told to a callback on the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: What is told at most before an action has ended: more stages may follow.
NEARLY = 0.99


def share_done(tracker, group: str) -> float:
    """Completed tasks of those in the stages that the group's jobs have started."""
    done = total = 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in getattr(tracker.getJobInfo(job), "stageIds", ()):
            if (s := tracker.getStageInfo(stage)) is not None:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done / total if total else 0.0


def with_progress(spark: SparkSession, action: Callable[[], object], progress: Callable[[float], None], every: float = 0.5):
    """What ``action`` returns. ``progress`` is told 0 first, then every so many seconds the share of tasks that have ended if that has
    grown (tasks that lost executors must repeat take nothing back), and 1 last. An error of the action is raised here, without the 1;
    an error of the callback cancels the action's jobs."""
    sc, group, out = spark.sparkContext, f"progress-{uuid.uuid4().hex}", {}

    def run():
        sc.setJobGroup(group, "an action with progress")
        try:
            out["value"] = action()
        except BaseException as e:  # raised below, in the caller's thread
            out["error"] = e

    worker, told = InheritableThread(target=run, session=spark), 0.0
    progress(0.0)
    worker.start()
    try:
        while worker.is_alive():
            worker.join(every)
            now = min(NEARLY, share_done(sc.statusTracker(), group))
            if worker.is_alive() and now > told:
                progress(told := now)
    except BaseException:
        sc.cancelJobGroup(group)
        worker.join()
        raise
    if "error" in out:
        raise out["error"]
    progress(1.0)
    return out["value"]
