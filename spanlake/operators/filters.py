"""The common filter object and the predicates it turns into."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: bucket names and their seconds, period names
BUCKETS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}
PERIODS = ("day", "week", "month")
MAX_BUCKETS = 2000
DEFAULT_LIMIT, MAX_LIMIT = 100, 500


@dataclass(frozen=True)
class Filters:
    """Optional predicates; an unset field filters nothing. ``start`` and ``end`` are inclusive."""

    instance: str | None = None
    agent: str | None = None
    status: str | None = None
    start: str | None = None
    end: str | None = None
    event_type: str | None = None
    limit: int | None = None
    cursor: tuple[str, ...] | None = None

    @property
    def rows(self) -> int:
        if self.limit is None:
            return DEFAULT_LIMIT
        return self.limit

    def __post_init__(self) -> None:
        self.checked()

    def checked(self) -> "Filters":
        if self.limit is not None and not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError("limit must be between 1 and 500")
        if self.start and self.end and _instant(self.start) >= _instant(self.end):
            raise ValueError("start must be before end")
        return self

    def but(self, **changes) -> "Filters":
        return replace(self, **changes)


def _instant(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)


def bucket_seconds(bucket: str, p: Filters | None = None) -> int:
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {sorted(BUCKETS)}")
    seconds = BUCKETS[bucket]
    if p and p.start and p.end and (_instant(p.end) - _instant(p.start)) / timedelta(seconds=seconds) > MAX_BUCKETS:
        raise ValueError("too many buckets for this range")
    return seconds


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def blank_to(name: str, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def narrowed(df: DataFrame, p: Filters, time: str | Column | None = "started_at",
             status: str | None = "status", agent: str | None = None) -> DataFrame:
    if p.instance:
        df = df.where(F.col("instance_id") == p.instance)
    if time is not None:
        at = F.col(time) if isinstance(time, str) else time
        if p.start:
            df = df.where(at >= instant(p.start))
        if p.end:
            df = df.where(at <= instant(p.end))
    if status and p.status:
        df = df.where(F.col(status) == p.status)
    if agent and p.agent:
        df = df.where(F.col(agent) == p.agent)
    return df


def newest(df: DataFrame, time: str, key: str, p: Filters, extra: int = 0) -> DataFrame:
    """Newest first by (time, key); rows after the cursor only; ``extra`` rows tell that more follow.

    The instance breaks ties between equal keys of two instances, so the page is always the same.  A cursor is the time, the
    key and, where two instances may share both, the instance of the last row seen.
    """
    if p.cursor:
        at, ident, *instance = p.cursor
        same_time = F.col(time) == instant(at)
        later = (F.col(time) < instant(at)) | (same_time & (F.col(key) < ident))
        if instance and "instanceId" in df.columns:
            later |= same_time & (F.col(key) == ident) & (F.col("instanceId") < instance[0])
        df = df.where(later)
    order = [F.col(time).desc(), F.col(key).desc()]
    if "instanceId" in df.columns:
        order.append(F.col("instanceId").desc())
    return df.orderBy(*order).limit(p.rows + extra)
