"""Keyed state that sees the events of a key in order of event time."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: Milliseconds of event time that are read and written together.
BUCKET_MS = 60_000
#: Events that a key holds in one value of its state, and that are folded together, or one bucket's if it has more.
FOLD_ROWS = 10_000


class OrderedProcessor(StatefulProcessor):
    """Holds events back until the watermark has passed them, then folds them in order.

    A subclass names the event columns in ``waiting_schema`` (with ts and event_id) and folds released events in ``fold``.
    Every access to the state store is a message of its own, so a key that holds back few events has them in one value, read
    and written once a batch. Beyond FOLD_ROWS, they move to a map by minutes of their time: arriving events
    read and write the minutes they fall into, and a timer reads the minutes that are due, one after the
    other. So a task holds about FOLD_ROWS events or one minute of a key at a time, however much the key holds back.
    Times are whole microseconds in state and in ``fold``. Events without time are never due and are not kept.
    """

    waiting_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {**dict(part.split() for part in self.waiting_schema.split(",")), "ts": "bigint"}
        events = f"events array<struct<{', '.join(f'{name}: {kind}' for name, kind in kinds.items())}>>"
        # ``wake``: the earliest timer that is set; ``parted``: whether there are minutes in the map.
        self.held = handle.getValueState("held", f"wake bigint, parted boolean, {events}")
        self.waiting = handle.getMapState("waiting", "ms bigint", events)
        self.event = namedtuple("Event", kinds)
        # A column with missing values arrives as floats; state rows need whole numbers.
        self.whole = {name for name, kind in kinds.items() if kind in ("int", "bigint")}

    def _events(self, frame: pd.DataFrame) -> list[tuple]:
        timed = frame["ts"].notna()
        frame = frame if timed.all() else frame[timed]
        columns = []
        for name in self.event._fields:
            if name == "ts":
                columns.append(pd.DatetimeIndex(frame["ts"]).as_unit("us").asi8.tolist())
                continue
            values = (None if value is None or value != value else value for value in frame[name].tolist())
            columns.append([value if value is None else int(value) for value in values] if name in self.whole else list(values))
        return list(zip(*columns))

    def fold(self, key, events: list) -> pd.DataFrame | None:
        raise NotImplementedError

    def _read(self, events) -> list:
        return [self.event(*event) for event in events]

    def _part(self, events: list) -> None:
        """Move events to the minutes of their time."""
        by_minute: dict[int, list] = {}
        for event in self._read(events):
            by_minute.setdefault(event.ts // (1000 * BUCKET_MS), []).append(tuple(event))
        for minute, news in by_minute.items():
            if self.waiting.containsKey((minute,)):
                news = [*map(tuple, self.waiting.getValue((minute,))[0]), *news]
            self.waiting.updateValue((minute,), (news,))

    def _hold(self, wake: int | None, parted: bool, events: list) -> None:
        if wake is None:
            self.held.clear()
        else:
            self.held.update((wake, parted, [tuple(event) for event in events]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wake, parted, events = self.held.get() or (None, False, [])
        events, oldest = list(events), None
        for frame in rows:
            news = self._events(frame)
            if not news:
                continue
            first = min(event[self.event._fields.index("ts")] for event in news)
            oldest = first if oldest is None else min(oldest, first)
            events += news
            if len(events) > FOLD_ROWS:
                self._part(events)
                parted, events = True, []
        if oldest is not None:
            due = oldest // 1000 + 1
            if wake is None or due < wake:
                self.handle.registerTimer(due)
                wake = due
            self._hold(wake, parted, events)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wake, parted, events = self.held.get() or (None, False, [])
        watermark = timerValues.getCurrentWatermarkInMs()
        if wake is None or wake > watermark:
            return  # an earlier timer has done this one's work
        if parted:
            self._part(events)
            later = yield from self._fold_minutes(key, watermark)
            parted, events = later is not None, []
        else:
            events = self._read(events)
            yield from self._folded(key, [event for event in events if event.ts <= watermark * 1000])
            events = [event for event in events if event.ts > watermark * 1000]
            later = min(event.ts for event in events) // 1000 + 1 if events else None
        if later is not None:
            self.handle.registerTimer(later)
        self._hold(later, parted, events)

    def _fold_minutes(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Fold what is due in the map; the time of the next timer, None if nothing is left."""
        last = watermark // BUCKET_MS
        places = sorted(place[0] for place in self.waiting.keys())
        later = next((place * BUCKET_MS + 1 for place in places if place > last), None)
        held: list = []
        for place in places:
            if place > last:
                break
            events = self._read(self.waiting.getValue((place,))[0])
            rest = [event for event in events if event.ts > watermark * 1000]
            if rest:  # the minute that the watermark is in
                self.waiting.updateValue((place,), ([tuple(event) for event in rest],))
                later = min(event.ts for event in rest) // 1000 + 1
            else:
                self.waiting.removeKey((place,))
            held += [event for event in events if event.ts <= watermark * 1000]
            if len(held) >= FOLD_ROWS:
                yield from self._folded(key, held)
                held = []
        yield from self._folded(key, held)
        return later

    def _folded(self, key, due: list) -> Iterator[pd.DataFrame]:
        if not due:
            return
        # An event without id comes after the others of its time.
        result = self.fold(key, sorted(due, key=lambda e: (e.ts, e.event_id is None, e.event_id or 0)))
        if result is not None and not result.empty:
            yield result

    def close(self) -> None:
        pass
