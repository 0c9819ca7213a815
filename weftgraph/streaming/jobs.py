"""The indexing queue as a state machine: one state for each key, the same fold in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS, BASE_MS, MOST_MS, LEASE_MS = 5, 1_000, 60_000, 30_000
EVENTS = ("enqueue", "lease", "renew", "accept", "complete", "retry", "cancel", "expire")
TOLD = ("operation", "document_hash", "owner")  # what an event may say besides its kind


@dataclass
class Job:
    """status: none, pending, leased or failed. operation and hash say what is to be done; owner holds the lease."""

    status: str = "none"
    attempts: int = 0
    available_at: int = 0
    lease_until: int = 0
    completed: int = 0
    superseded: int = 0
    operation: str | None = None
    document_hash: str | None = None
    owner: str | None = None
    accepted_at: int | None = None

    def _free(self, status: str, available_at: int) -> None:
        self.status, self.available_at, self.lease_until, self.owner, self.accepted_at = status, available_at, 0, None, None

    def apply(self, event: str, now: int, operation: str | None = None, document_hash: str | None = None, owner: str | None = None) -> None:
        """One event; those that the state doesn't allow change nothing, a late completion is counted as superseded.

        The same operation on the same text joins a job that waits or runs; any other replaces it, and the lease is lost.
        Renewing, accepting, completing and retrying take the owner of the lease.
        """
        if self.status == "leased" and self.lease_until <= now:
            self._free("pending", now)
        held = self.status == "leased" and self.owner == owner
        if event == "enqueue":
            same = (self.operation, self.document_hash) == (operation, document_hash)
            if not (same and self.status in ("pending", "leased")):
                self._free("pending", now)
                self.attempts, self.operation, self.document_hash = 0, operation, document_hash
        elif event == "lease":
            if self.status == "pending" and self.available_at <= now:
                self.status, self.lease_until, self.owner = "leased", now + LEASE_MS, owner
        elif event == "renew":
            if held:
                self.lease_until = now + LEASE_MS
        elif event == "accept":
            if held:
                self.accepted_at = now
        elif event == "complete":
            if held:
                self._free("none", self.available_at)
                self.completed, self.operation, self.document_hash = self.completed + 1, None, None
            else:
                self.superseded += 1
        elif event == "retry":
            if held:
                self.attempts += 1
                if self.attempts >= MOST_ATTEMPTS:
                    self._free("failed", self.available_at)
                else:
                    self._free("pending", now + min(MOST_MS, BASE_MS * 2**self.attempts))
        elif event == "cancel":
            self._free("none", self.available_at)
            self.operation = self.document_hash = None


STATE = "status string, attempts long, available_at long, lease_until long, completed long, superseded long, operation string, document_hash string, owner string, accepted_at long"
NAMES = [f.name for f in fields(Job)]


def _events(events: DataFrame, key: str) -> DataFrame:
    """The columns that a fold reads; what an event doesn't tell is null."""
    return events.select(key, "event", "ts_ms", "seq", *[F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in TOLD])


def _apply(job: Job, rows: pd.DataFrame) -> Job:
    rows = rows.sort_values(["ts_ms", "seq"])
    told = rows[list(TOLD)].astype(object).where(rows[list(TOLD)].notna(), None)
    for event, now, *said in zip(rows["event"], rows["ts_ms"], *(told[c] for c in TOLD), strict=True):
        job.apply(event, int(now), *said)
    return job


def fold(events: DataFrame, key: str = "key") -> DataFrame:
    """Batch: the state of each key after all its events (key, event, ts_ms, seq, and maybe operation, document_hash, owner),
    in order of time and seq."""
    kind = dict(events.dtypes)[key]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: f[key].iloc[0], **asdict(_apply(Job(), f))}])

    return _events(events, key).groupBy(key).applyInPandas(run, f"`{key}` {kind}, {STATE}")


def stream(events: DataFrame, key: str = "key") -> DataFrame:
    """Streaming: the state of each key after each micro-batch in which it has events; expired leases are seen at the next event."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = _apply(Job(*state.get) if state.exists else Job(), pd.concat(list(frames)))
        state.update(tuple(asdict(job).values()))
        yield pd.DataFrame([{key: name[0], **asdict(job)}])

    return _events(events, key).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def lease(jobs: DataFrame, now: int, limit: int) -> DataFrame:
    """The next jobs to lease: pending and available, by availability and id."""
    return jobs.where((F.col("status") == "pending") & (F.col("available_at") <= now)).orderBy("available_at", "id").limit(limit)


def expired(jobs: DataFrame, now: int) -> DataFrame:
    """Leased jobs whose lease has run out, as pending."""
    return jobs.where((F.col("status") == "leased") & (F.col("lease_until") <= now)).withColumn("status", F.lit("pending"))


def ingestion_plan(backlog: DataFrame, enter: int = 2048, leave: int = 1024) -> DataFrame:
    """backlog (step, outstanding): cold above enter, steady at or below leave, in between as it was before; steady at first."""
    from pyspark.sql import Window

    mark = F.when(F.col("outstanding") > enter, "cold").when(F.col("outstanding") <= leave, "steady")
    w = Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return backlog.withColumn("profile", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit("steady")))


# How much a component's state weighs; any other state weighs nothing.
HEALTH = {"unknown": 0, "disabled": 0, "healthy": 1, "starting": 2, "indexing": 2, "degraded": 3, "recovering": 4, "stalled": 5, "failed": 6}


def health(components: DataFrame, *by: str) -> DataFrame:
    """components (…, component, state): the worst state, of equal ones that of the last component, and how many have it.

    States are counted before they are compared, so no group's components are gathered.
    """
    weight = F.create_map(*[F.lit(x) for kv in HEALTH.items() for x in kv])
    counted = components.groupBy(*by, "state").agg(F.count("*").alias("n"), F.max("component").alias("last"))
    rank = F.struct(F.coalesce(weight[F.col("state")], F.lit(0)).alias("weight"), "last", "state", "n")
    return counted.groupBy(*by).agg(F.max(rank).alias("r")).select(*by, F.coalesce("r.state", F.lit("unknown")).alias("worst"), F.col("r.n").alias("components"))
