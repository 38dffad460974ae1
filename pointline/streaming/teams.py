"""Conditions over all members of a team on a stream, judged at the end of each day.

Four stateful operators in a chain. Points are summed per player and day (map-side, so a hot player arrives as one row), and the sum
is passed on once the watermark has closed the day. A small processor per player keeps the total and tells the days on which the
player begins or ceases to hold the condition. These changes are summed per team and day. A processor per team keeps how many
members fail; when none does, a run begins, and an event-time timer tells that it has lasted, also if nothing happens any more.

All rows of a day reach the last operator in the micro-batch that closes the day, before timers are looked at, so the result does not
depend on how the ledger is cut into files or micro-batches.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import calendar as cal

# The processors travel with the query, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPOCH = dt.date(1970, 1, 1).toordinal()
MILLIS_PER_DAY = 86_400_000
NO_RUN = -(1 << 40)


def held_day(first: int, months: int, days: int) -> int:
    """The day (since the epoch) that ends a span from ``first`` on; a month too short carries its surplus days over."""
    day = dt.date.fromordinal(first + EPOCH)
    month = day.year * 12 + day.month - 1 + months
    return dt.date(month // 12, month % 12 + 1, 1).toordinal() - EPOCH + day.day - 1 + days


class CrossingProcessor(StatefulProcessor):
    """From a player's closed days the days that change whether the total is at ``level``: -1 member fails less, +1 more."""

    SCHEMA = "player_id bigint, delta int, ts timestamp"

    def __init__(self, level: int):
        self.level = level

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0] if self.total.exists() else 0
        days = pd.concat(list(rows), ignore_index=True).sort_values("ts", ignore_index=True)
        totals = total + days["points"].cumsum()
        fails = (totals < self.level).astype("int32")
        delta = fails.diff().fillna(fails.iloc[0] - int(total < self.level)).astype("int32")
        self.total.update((int(totals.iloc[-1]),))
        turns = delta != 0
        yield pd.DataFrame({"player_id": [key[0]] * int(turns.sum()), "delta": delta[turns].to_numpy(), "ts": days["ts"][turns].to_numpy()})

    def close(self) -> None:
        pass


class AllMembersProcessor(StatefulProcessor):
    """Runs of days on which no member of a team fails, told once they have lasted."""

    SCHEMA = "team string, from_number int, held_number int"

    def __init__(self, first_day: int, months: int, days: int):
        self.first_day, self.months, self.days = first_day, months, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # members that fail, first day of the present run, 1 if the run was told
        self.run = handle.getValueState("run", "failing bigint, start bigint, told bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        failing = int(initialState["failing"].iloc[0])
        start = NO_RUN if failing else self.first_day
        self.run.update((failing, start, 0))
        if not failing:
            self._wait(start)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.run.exists():  # a team without members
            return
        failing, start, told = self.run.get()
        before = start
        changes = pd.concat(list(rows), ignore_index=True).sort_values("day")
        found = []
        for day, delta in zip(changes["day"].tolist(), changes["delta"].tolist()):  # one row a day
            failing += delta
            if failing and start != NO_RUN:
                if not told and max(day, self.first_day) - 1 >= held_day(start, self.months, self.days):
                    found.append(self._row(key, start))
                start, told = NO_RUN, 0
            elif not failing and start == NO_RUN:
                start, told = max(day, self.first_day), 0
        self.run.update((failing, start, told))
        if start != before:
            if before != NO_RUN:
                self._forget(before)
            if start != NO_RUN:
                self._wait(start)
        yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failing, start, told = self.run.get()
        due = start != NO_RUN and not told and self._expiry(start) == expiredTimerInfo.getExpiryTimeInMs()
        if due:
            self.run.update((failing, start, 1))
        yield self._frame([self._row(key, start)] if due else [])

    def _row(self, key, start: int) -> tuple:
        return key[0], start, held_day(start, self.months, self.days)

    @staticmethod
    def _frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["team", "from_number", "held_number"]).astype({"from_number": "int32", "held_number": "int32"})

    def _expiry(self, start: int) -> int:
        """The end of the day that the run must reach."""
        return (held_day(start, self.months, self.days) + 1) * MILLIS_PER_DAY

    def _wait(self, start: int) -> None:
        self.handle.registerTimer(self._expiry(start))

    def _forget(self, start: int) -> None:
        if self._expiry(start) in set(self.handle.listTimers()):
            self.handle.deleteTimer(self._expiry(start))

    def close(self) -> None:
        pass


def all_members_sustained(entries: DataFrame, players: DataFrame, level: int, first_day: dt.date, months: int = 0, days: int = 0,
                          lateness: str = "0 seconds") -> DataFrame:
    """Teams all of whose members closed every day of a span with ``level`` or more: ``team, from_day, held_on``, as ``snapshots.sustained``
    has them, a row per run that lasted. ``players`` is a static table, and a player starts at 0.

    ``entries`` may hold rows without player (``sources.with_clock``), which only move the watermark.
    """
    day = F.window("ts", "1 day")
    closed = entries.withWatermark("ts", lateness).groupBy(day.alias("w"), "player_id").agg(F.sum("points").alias("points"))
    closed = closed.select("player_id", "points", F.window_time("w").alias("ts"))
    turns = closed.groupBy("player_id").transformWithStateInPandas(
        CrossingProcessor(level), CrossingProcessor.SCHEMA, outputMode="append", timeMode="eventTime", eventTimeColumnName="ts")
    members = players.select("player_id", "team")
    by_team = turns.join(members, "player_id").groupBy(day.alias("w"), "team").agg(F.sum("delta").alias("delta"))
    by_team = by_team.select("team", "delta", F.unix_date(F.to_date(cal.as_wall_clock(F.col("w.start")))).alias("day"))
    fails = F.lit(int(0 < level)).cast("bigint")
    start = members.groupBy("team").agg((F.count(F.lit(1)) * fails).alias("failing")).groupBy("team")
    first = first_day.toordinal() - EPOCH
    runs = by_team.groupBy("team").transformWithStateInPandas(
        AllMembersProcessor(first, months, days), AllMembersProcessor.SCHEMA, outputMode="append", timeMode="eventTime", initialState=start)
    return runs.select("team", F.date_from_unix_date("from_number").alias("from_day"), F.date_from_unix_date("held_number").alias("held_on"))
