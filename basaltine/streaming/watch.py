"""Watching a growing event log: each new run is compared with the one before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes


@dataclass
class Hooks:
    """Callbacks of a watch; their failures are kept and do not stop it."""

    on_cycle: list[Callable[[int, DataFrame], None]] = field(default_factory=list)
    on_change: list[Callable[[int, DataFrame], None]] = field(default_factory=list)
    failures: list[tuple[str, str]] = field(default_factory=list)

    def call(self, run_id: int, events: DataFrame, changed: bool) -> None:
        for name, hooks in (("cycle", self.on_cycle), ("change", self.on_change if changed else [])):
            for hook in hooks:
                try:
                    hook(run_id, events)
                except Exception as error:  # noqa: BLE001  a hook must not stop the watch
                    self.failures.append((name, f"{type(error).__name__}: {error}"))


def json_lines(events: DataFrame, run_id: int, path: str) -> None:
    """Append one JSON object with sorted keys for each event."""
    names = sorted([*events.columns, "run_id"])
    events.withColumn("run_id", F.lit(run_id)).select(F.to_json(F.struct(*names)).alias("value")).write.mode("append").text(path)


def watch(
    spark: SparkSession, finished_runs: DataFrame, tables: Callable[[], dict[str, DataFrame]], project_id: str, checkpoint: str, sink: str | None = None, hooks: Hooks | None = None, interval: str | None = None,
) -> StreamingQuery:
    """Start the watch over a stream of finished runs (id); without an interval it takes what is there and ends.

    The first run of a project is the baseline: it makes no events.
    """
    hooks = hooks or Hooks()

    def cycle(batch: DataFrame, _: int) -> None:
        for row in batch.select("id").distinct().orderBy("id").collect():  # runs of one trigger, a few numbers
            now = tables()
            before = now["runs"].where((F.col("project_id") == project_id) & (F.col("id") < row.id) & F.col("finished_at").isNotNull()).agg(F.max("id")).first()[0]
            if before is None:
                continue
            kept = changes.coverage(changes.compare_runs(now, project_id, before, row.id), now["page_visits"], project_id, before, row.id).where("suppressed IS NULL").drop("suppressed").cache()
            changed = not kept.isEmpty()
            if sink and changed:
                json_lines(kept, row.id, sink)
            hooks.call(row.id, kept, changed)
            kept.unpersist()

    writer = finished_runs.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def sliding_requests(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """How many requests each provider had made in the seconds before each one."""
    from pyspark.sql import Window

    over = Window.partitionBy("provider").orderBy(F.unix_seconds(F.col("at").cast("timestamp"))).rangeBetween(-seconds + 1, 0)
    return calls.withColumn("recent", F.count("*").over(over))
