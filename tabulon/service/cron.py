"""Cron expressions of six or seven fields: seconds, minutes, hours, day of month, month, day of week, year."""

from __future__ import annotations

import calendar
import threading
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from tabulon.errors import InvalidRequest

MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
DAYS = {d: i for i, d in enumerate("SUN MON TUE WED THU FRI SAT".split(), 1)}
_FIELDS = (("second", 0, 59, {}), ("minute", 0, 59, {}), ("hour", 0, 23, {}), ("day of month", 1, 31, {}), ("month", 1, 12, MONTHS), ("day of week", 1, 7, DAYS), ("year", 1970, 2099, {}))


def _values(text: str, name: str, lo: int, hi: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        try:
            every = int(step) if step else 1
            number = lambda x: names[x.upper()] if x.upper() in names else int(x)
            if span in ("*", "?"):
                a, b = lo, hi
            elif "-" in span:
                a, b = map(number, span.split("-", 1))
            else:
                a = number(span)
                b = hi if step else a
        except (ValueError, KeyError) as e:
            raise InvalidRequest(f"Invalid {name} {part!r} in cron expression") from e
        if every < 1 or not lo <= a <= hi or not lo <= b <= hi:
            raise InvalidRequest(f"Invalid {name} {part!r} in cron expression")
        run = range(a, b + 1, every) if a <= b else [*range(a, hi + 1), *range(lo, b + 1)][::every]
        out.update(run)
    return out


class Cron:
    """A parsed expression in a time zone. One of the two day fields must be ``?``.

    Days of the month also know ``L`` (last), ``L-3``, ``W`` (nearest weekday); days of the week ``6L`` (last Friday) and ``6#3`` (third Friday).
    """

    def __init__(self, text: str, zone: str = "UTC"):
        parts = text.split()
        if len(parts) not in (6, 7):
            raise InvalidRequest(f"Cron expression {text!r} must have 6 or 7 fields")
        if (parts[3] == "?") == (parts[5] == "?"):
            raise InvalidRequest("One of day of month and day of week must be '?'")
        try:
            self.zone = ZoneInfo(zone)
        except (ZoneInfoNotFoundError, ValueError) as e:
            raise InvalidRequest(f"Unknown time zone {zone!r}") from e
        self.dom, self.dow = parts[3].upper(), parts[5].upper()
        special = {3: any(c in self.dom for c in "LW"), 5: "#" in self.dow or self.dow.endswith("L")}
        self.sets = [set() if special.get(i) else _values(p, *_FIELDS[i]) for i, p in enumerate([*parts, "*"][:7])]
        if special[5]:
            _values(self.dow.replace("L", "").partition("#")[0] or "7", *_FIELDS[5])

    def _days(self, year: int, month: int) -> list[int]:
        last = calendar.monthrange(year, month)[1]
        week = lambda d: (calendar.weekday(year, month, d) + 1) % 7 + 1
        if self.dow == "?":
            if "W" in self.dom:
                at = last if self.dom.startswith("L") else min(int(self.dom.rstrip("W")), last)
                move = {7: -1 if at > 1 else 2, 1: 1 if at < last else -2}
                return [at + move.get(week(at), 0)]
            if self.dom.startswith("L"):
                return [d for d in [last - int(self.dom[2:] or 0)] if d >= 1]
            return [d for d in range(1, last + 1) if d in self.sets[3]]
        if "#" in self.dow:
            name, _, nth = self.dow.partition("#")
            days = [d for d in range(1, last + 1) if week(d) in _values(name, *_FIELDS[5])]
            return days[int(nth) - 1 : int(nth)]
        if self.dow.endswith("L") and self.dow != "L":
            return [d for d in range(1, last + 1) if week(d) in _values(self.dow[:-1], *_FIELDS[5])][-1:]
        wanted = {7} if self.dow == "L" else self.sets[5]
        return [d for d in range(1, last + 1) if week(d) in wanted]

    def next_after(self, at: datetime) -> datetime | None:
        """The first time after ``at`` (in UTC), or None if there is none."""
        start = at.astimezone(self.zone)
        hours, minutes, seconds = (sorted(self.sets[i]) for i in (2, 1, 0))
        for year in sorted(y for y in self.sets[6] if y >= start.year):
            for month in sorted(self.sets[4]):
                if (year, month) < (start.year, start.month):
                    continue
                for day in self._days(year, month):
                    if (year, month, day) < (start.year, start.month, start.day):
                        continue
                    for h in hours:
                        if (year, month, day, h) < (start.year, start.month, start.day, start.hour):
                            continue
                        for m in minutes:
                            for s in seconds:
                                t = datetime(year, month, day, h, m, s, tzinfo=self.zone)
                                utc = t.astimezone(timezone.utc)
                                if utc > at and utc.astimezone(self.zone).replace(tzinfo=None) == t.replace(tzinfo=None):  # skipped hours don't fire
                                    return utc
        return None


class Scheduler:
    """Fires callbacks at cron times on one thread. Times that passed while it was busy or down are not made up for."""

    def __init__(self, fire: Callable[[int], None]):
        self.fire, self.jobs, self.due = fire, {}, {}
        self.wake, self.stopped = threading.Condition(), False
        self.thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> Scheduler:
        self.thread.start()
        return self

    def sync(self, job_id: int, cron: str | None, zone: str = "UTC", enabled: bool = True) -> None:
        """Schedule, reschedule or remove a job."""
        with self.wake:
            self.jobs.pop(job_id, None)
            self.due.pop(job_id, None)
            if cron and enabled:
                self.jobs[job_id] = Cron(cron, zone)
                self.due[job_id] = self.jobs[job_id].next_after(datetime.now(timezone.utc))
            self.wake.notify()

    def next_fire(self, job_id: int) -> datetime | None:
        return self.due.get(job_id)

    def _loop(self) -> None:
        while True:
            with self.wake:
                if self.stopped:
                    return
                now_ = datetime.now(timezone.utc)
                ready = [j for j, t in self.due.items() if t and t <= now_]
                for j in ready:
                    self.due[j] = self.jobs[j].next_after(now_)
                if not ready:
                    times = [t for t in self.due.values() if t]
                    self.wake.wait(max(0.01, (min(times) - now_) / timedelta(seconds=1)) if times else None)
                    continue
            for j in ready:
                threading.Thread(target=self.fire, args=(j,), daemon=True).start()

    def stop(self) -> None:
        with self.wake:
            self.stopped = True
            self.wake.notify()
