"""Per-player state on a stream: counters, awards given once, conditions that last.

The processors see one player's new entries of a micro-batch at a time and put them in order of ``id``; micro-batches come in
order of arrival. The source's limit per trigger bounds the entries of one call. All arithmetic is on whole arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import calendar as cal
from ..functions import text
from ..operators.awards import ENTRY_RULES, RULES, Rule, grant

# The processors travel with the query, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS = ("n", "score", "lowest_score", "current_streak", "max_streak", "praise_count")
MICROS_PER_DAY = 86_400_000_000


def _ordered(batches: Iterable[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values("id", ignore_index=True)


def _advance(rows: pd.DataFrame, before: tuple) -> pd.DataFrame:
    """State after each of the ordered entries, given the state before the first."""
    n, score, lowest, streak, longest, praise = before
    points = rows["points"].to_numpy()
    place = np.arange(len(points))
    last_reset = np.maximum.accumulate(np.where(points <= 0, place, -1))
    total = score + np.cumsum(points)
    run = np.where(last_reset < 0, place + 1 + streak, place - last_reset)
    return pd.DataFrame({
        "n": n + place + 1, "total": total, "lowest": np.minimum(np.minimum.accumulate(total), lowest), "streak": run,
        "longest": np.maximum(np.maximum.accumulate(run), longest),
        "praise": praise + np.cumsum(rows["praise"].to_numpy().astype("int64")),
    })


class StateProcessor(StatefulProcessor):
    """Emits a player's counters after every micro-batch with entries of that player."""

    SCHEMA = "player_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", ", ".join(f"{c} bigint" for c in COUNTERS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.counters.get() if self.counters.exists() else (0,) * len(COUNTERS)
        after = tuple(int(v) for v in _advance(_ordered(rows), before).iloc[-1])
        self.counters.update(after)
        yield pd.DataFrame([(key[0], *after)], columns=["player_id", *COUNTERS])

    def close(self) -> None:
        pass


class AwardProcessor(StateProcessor):
    """Emits each award once per player, at the entry that first met its predicate."""

    SCHEMA = "player_id bigint, badge_id string, earned_us bigint"

    def __init__(self, rules: Sequence[Rule]):
        self.predicates = [(r.badge_id, r.predicate.replace(" AND ", " and ")) for r in rules]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.given = handle.getValueState("given", "badges string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.counters.get() if self.counters.exists() else (0,) * len(COUNTERS)
        entries = _ordered(rows)
        states = _advance(entries, before)
        self.counters.update(tuple(int(v) for v in states.iloc[-1]))
        given = self.given.get()[0].split(",") if self.given.exists() else []
        new = []
        for badge_id, predicate in self.predicates:
            if badge_id not in given:
                met = states.eval(predicate).to_numpy()
                if met.any():
                    new.append((key[0], badge_id, int(entries["us"].iloc[int(met.argmax())])))
        if new:
            self.given.update((",".join([*given, *[b for _, b, _ in new]]),))
        yield pd.DataFrame(new, columns=["player_id", "badge_id", "earned_us"])


class SustainedProcessor(StatefulProcessor):
    """Emits runs of ``total >= level`` that last ``days`` days, by a later entry or by an event-time timer."""

    SCHEMA = "player_id bigint, from_us bigint, held_us bigint"

    def __init__(self, level: int, days: int):
        self.level, self.span = level, days * MICROS_PER_DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # total, start of the present run (-1: none), 1 if the run was emitted
        self.run = handle.getValueState("run", "total bigint, start bigint, told bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, start, told = self.run.get() if self.run.exists() else (0, -1, 0)
        entries = _ordered(rows)
        totals = total + entries["points"].cumsum().to_numpy()
        times = entries["us"].to_numpy()
        holds = totals >= self.level
        turns = np.flatnonzero(np.diff(np.concatenate(([start >= 0], holds)).astype("int8")))
        found = []
        for at in turns:
            if holds[at]:
                start, told = int(times[at]), 0
            else:
                if not told and times[at] >= start + self.span:
                    found.append((key[0], start, start + self.span))
                self._forget_timer(start)
                start, told = -1, 0
        if start >= 0 and not told:
            if times[-1] >= start + self.span:
                found.append((key[0], start, start + self.span))
                told = 1
                self._forget_timer(start)
            else:
                self.handle.registerTimer((start + self.span) // 1000)
        self.run.update((int(totals[-1]), start, told))
        yield pd.DataFrame(found, columns=["player_id", "from_us", "held_us"])

    def _forget_timer(self, start: int) -> None:
        expiry = (start + self.span) // 1000
        if expiry in set(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, start, told = self.run.get()
        found = []
        if start >= 0 and not told and (start + self.span) // 1000 == expiredTimerInfo.getExpiryTimeInMs():
            found.append((key[0], start, start + self.span))
            self.run.update((total, start, 1))
        yield pd.DataFrame(found, columns=["player_id", "from_us", "held_us"])

    def close(self) -> None:
        pass


def _moment(micros: str):
    return cal.as_wall_clock(F.timestamp_micros(micros))


def _keyed(entries: DataFrame, praise: Sequence[str]):
    return entries.select(
        "player_id", "id", "points", F.unix_micros("ts").alias("us"), "ts",
        text.contains_any(F.col("action"), praise, True).alias("praise")).groupBy("player_id")


def player_state(entries: DataFrame, praise: Sequence[str] = (text.PRAISE_KEYWORD,)) -> DataFrame:
    """Counters of a player after each micro-batch; the row with the greatest ``n`` is the present one."""
    return _keyed(entries, praise).transformWithStateInPandas(
        StateProcessor(), StateProcessor.SCHEMA, outputMode="append", timeMode="none")


def awards_once(entries: DataFrame, praise: Sequence[str] = (text.PRAISE_KEYWORD,),
                rules: Iterable[Rule] = RULES) -> DataFrame:
    """Awards decided by a player's own entries, each at most once per player."""
    processor = AwardProcessor([r for r in rules if r.badge_id in ENTRY_RULES])
    found = _keyed(entries, praise).transformWithStateInPandas(
        processor, AwardProcessor.SCHEMA, outputMode="append", timeMode="none")
    return grant(found.select(
        "player_id", "badge_id", _moment("earned_us").alias("date_earned")), "player", rules)


def sustained(entries: DataFrame, level: int, days: int, lateness: str = "1 day") -> DataFrame:
    """Players whose total stayed at ``level`` or more for ``days`` days."""
    return _keyed(entries.withWatermark("ts", lateness), ()).transformWithStateInPandas(
        SustainedProcessor(level, days), SustainedProcessor.SCHEMA, outputMode="append", timeMode="eventTime"
    ).select("player_id", _moment("from_us").alias("from_ts"), _moment("held_us").alias("held_ts"))
