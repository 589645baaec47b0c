"""Schedules in cron's five fields: minute, hour, day of month, month, day of week."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each field's least and greatest number, and names that stand for numbers.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
#: February 29 on a given weekday comes back within 40 years.
YEARS = 41


class Cron:
    """When a schedule runs.  A schedule that isn't valid, or never runs, is a ValueError.

    Where day and weekday are both restricted, either is enough.
    """

    def __init__(self, text: str):
        parts = text.lower().split()
        if len(parts) != len(FIELDS):
            raise ValueError(f"a schedule has five fields: {text!r}")
        self.minutes, self.hours, self.days, self.months, self.weekdays = (self._numbers(p, *f) for p, f in zip(parts, FIELDS))
        self.any_day, self.any_weekday = parts[2].startswith("*"), parts[4].startswith("*")
        if self.any_weekday and not any(d <= (29 if m == 2 else 30 if m in (4, 6, 9, 11) else 31) for m in self.months for d in self.days):
            raise ValueError(f"the schedule never runs: {text!r}")

    @staticmethod
    def _numbers(part: str, name: str, low: int, high: int) -> list[int]:
        names = {"month": {n: i + 1 for i, n in enumerate(MONTHS)}, "weekday": {n: i for i, n in enumerate(WEEKDAYS)} | {"7": 0}}.get(name, {})

        def number(text: str) -> int:
            value = names[text] if text in names else int(text)
            if not low <= value <= high:
                raise ValueError(f"{name} {text} is out of {low} to {high}")
            return value

        out: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            by = int(step) if step else 1
            if by < 1:
                raise ValueError(f"{name} has a step below one: {item}")
            if span == "*":
                first, last = low, high
            elif "-" in span:
                a, b = span.split("-")
                first, last = number(a), high if name == "weekday" and b == "7" else number(b)
                if name == "weekday" and b == "7":
                    out.add(0)
                if first > last:
                    raise ValueError(f"{name} has a range that ends before it begins: {item}")
            else:
                first = number(span)
                last = high if step else first
            out.update(range(first, last + 1, by))
        return sorted(out)

    def _runs_on(self, day: dt.date) -> bool:
        if day.month not in self.months:
            return False
        by_day, by_weekday = day.day in self.days, day.isoweekday() % 7 in self.weekdays
        return by_day and by_weekday if self.any_day or self.any_weekday else by_day or by_weekday

    def next(self, after: dt.datetime) -> dt.datetime:
        """The first run after a time."""
        start = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        day = start.date()
        for _ in range(366 * YEARS):
            if self._runs_on(day):
                least = (start.hour, start.minute) if day == start.date() else (0, 0)
                at = next(((h, m) for h in self.hours for m in self.minutes if (h, m) >= least), None)
                if at:
                    return dt.datetime.combine(day, dt.time(*at), start.tzinfo)
            day += dt.timedelta(days=1)
        raise ValueError("the schedule never runs")


def next_run(schedule: str | None, after: Column) -> Column:
    """The first run of a schedule after each row's time (without zone); null without a schedule or time."""
    cron = Cron(schedule) if schedule else None

    @F.pandas_udf("timestamp_ntz")
    def run(times: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for t in times:
            if cron is None or pd.isna(t):
                out.append(None)
                continue
            minute = t.floor("min")
            if minute not in seen:
                seen[minute] = cron.next(minute.to_pydatetime())
            out.append(seen[minute])
        return pd.Series(out, dtype="datetime64[us]")

    return run(after)


def interval_hours(schedule: str | None, now: dt.datetime) -> float:
    """Hours between the next two runs, one at least; a day without a schedule."""
    if not schedule:
        return 24.0
    cron = Cron(schedule)
    first = cron.next(now)
    return max((cron.next(first) - first).total_seconds() / 3600, 1.0)
