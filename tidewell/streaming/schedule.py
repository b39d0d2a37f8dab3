"""The recurring jobs, and which of them are due. Whatever runs on a clock calls `run_due`; nothing here reads one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from tidewell.conf import DEFAULT, EngineConf
from tidewell.operators import changes


@dataclass(frozen=True)
class Job:
    """Every so many minutes, or once a day at an hour and minute. run(index, now, conf) gives the index afterwards, or keys to pull."""

    name: str
    run: Callable[[DataFrame, str, EngineConf], DataFrame]
    every: int | None = None
    daily: tuple[int, int] | None = None

    def last_slot(self, now: datetime) -> datetime:
        midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
        if self.every is not None:
            return midnight + timedelta(minutes=((now - midnight) // timedelta(minutes=self.every)) * self.every)
        at = midnight + timedelta(hours=self.daily[0], minutes=self.daily[1])
        return at if at <= now else at - timedelta(days=1)


def jobs(conf: EngineConf = DEFAULT) -> dict[str, Job]:
    found = [
        Job("reindex_stale", changes.catch_up, every=conf.stale_reindex_minutes),
        Job("expire_signals", lambda index, now, _: changes.expired(index, now), every=5),
        Job("purge_tombstones", changes.purged, daily=conf.nightly_at),
    ]
    return {j.name: j for j in found}


def due(now: datetime, last: dict[str, datetime], conf: EngineConf = DEFAULT) -> list[Job]:
    """Jobs whose last slot came after they last ran."""
    return [j for j in jobs(conf).values() if j.name not in last or last[j.name] < j.last_slot(now)]


def run_due(index: DataFrame, now: datetime, last: dict[str, datetime], conf: EngineConf = DEFAULT) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """The index after the jobs that are due, the keys to pull again (None if that isn't due), and the names of the jobs."""
    text, keys, ran = now.strftime("%Y-%m-%d %H:%M:%S"), None, []
    for job in due(now, last, conf):
        out = job.run(index, text, conf)
        if job.name == "reindex_stale":
            keys = out
        else:
            index = out
        ran.append(job.name)
    return index, keys, ran
