"""A queue of several lanes with priorities, and periodic jobs with high-water marks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds between two runs of the periodic jobs.
PERIODS = {
    "embed": 30, "sleep": 600, "hygiene": 1800, "learning": 1800, "themes": 3600, "demotion": 3600, "replay": 3600, "distil": 7200, "belief": 7200, "promotion": 43_200, "staleness": 86_400,
}


def drain_lanes(lanes: dict[str, DataFrame], folder: str, good: str = "true") -> dict[str, str]:
    """Apply what waits in the lanes (streams), the first lane first; returns where each lane's rows are.

    Before each batch of a lane, those above it are drained again, so what is urgent doesn't wait behind what isn't. Rows go to
    folder/<lane>/applied, broken ones to folder/<lane>/dead, with the number of the turn in which they were applied (turn). A
    lane's checkpoint lies beside them: a restart takes up what wasn't applied, and a batch that is run again replaces its own files.
    """
    names, turns = list(lanes), [0]

    def drain(i: int) -> None:
        name, stream = names[i], lanes[names[i]]

        def apply(batch: DataFrame, number: int) -> None:
            for above in range(i):
                drain(above)
            turns[0] += 1
            for kind, rows in (("applied", batch.where(good)), ("dead", batch.where(f"not coalesce({good}, false)"))):
                rows.withColumn("turn", F.lit(turns[0])).write.mode("overwrite").parquet(f"{folder}/{name}/{kind}/batch={number}")

        stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/{name}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for i in range(len(names)):
        drain(i)
    return {name: f"{folder}/{name}/applied" for name in names}


@dataclass(frozen=True)
class Job:
    name: str
    seconds: int  #: between two runs
    run: Callable[[int, int], None]  #: works on what came from a time on and before another (microseconds)


class Jobs:
    """Periodic jobs whose high-water marks lie in a folder: what ran is not run again, by whatever driver."""

    def __init__(self, spark: SparkSession, folder: str, begin: int = 0):
        self.spark, self.folder, self.begin = spark, f"{folder.rstrip('/')}/marks", begin

    def marks(self) -> dict[str, int]:
        """Until when each job has run; a row for each run, so as many as there are runs."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return {}
        rows = self.spark.read.schema("name string, until long").parquet(self.folder)
        return {r.name: r.until for r in rows.groupBy("name").agg(F.max("until").alias("until")).collect()}

    def due(self, jobs: list[Job], now: int) -> list[tuple[Job, int]]:
        """The jobs whose period has passed since their last run, with the time from which they have to work."""
        marks = self.marks()
        return [(j, marks.get(j.name, self.begin)) for j in jobs if j.name not in marks or marks[j.name] + j.seconds * 1_000_000 <= now]

    def run(self, jobs: list[Job], now: int) -> list[str]:
        """Run what is due, each up to now, and mark it; a job that fails stays due, and those behind it too."""
        done = []
        for job, since in self.due(jobs, now):
            job.run(since, now)
            self.spark.createDataFrame([(job.name, now)], "name string, until long").coalesce(1).write.mode("append").parquet(self.folder)
            done.append(job.name)
        return done
