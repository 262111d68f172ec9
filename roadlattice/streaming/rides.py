"""Match and guidance of rides as one stateful stream: routes, positions and prompts are state of the ride."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import guidance as L

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a route that enter the state in one call.
CHUNK = 10_000
INPUT = "ride_id long, ts timestamp, event_id long, lon double, lat double, accuracy_m double, idx long, distance_m double, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ride(StatefulProcessor):
    """State of a ride: the points of its route, where it was matched last, and what it has been told."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "idx long, lon double, lat double, distance_m double, text string")
        self.place = handle.getValueState("place", L.MATCH_STATE)
        self.told = handle.getValueState("told", L.STATE)

    def _add(self, points: pd.DataFrame) -> None:
        rows = [(int(p.idx), float(p.lon), float(p.lat), float(p.distance_m), None if pd.isna(p.text) else p.text) for p in points.itertuples()]
        for k in range(0, len(rows), CHUNK):
            self.points.appendList(rows[k : k + CHUNK])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(initialState)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(rows))
        self._add(both[both["idx"].notna()])
        fixes = both[both["idx"].isna()].sort_values(["ts", "event_id"])
        route = sorted(self.points.get())
        if not len(fixes) or len(route) < 2:
            return
        place, at = L.match(self.place.get(), fixes, [{"lon": p[1], "lat": p[2], "distance_m": p[3]} for p in route])
        on = fixes.assign(route_m=[float(r[2]) for r in at], off_m=[float(r[3]) for r in at])
        told, events = L.advance(self.told.get(), on, [(p[3], p[4]) for p in route if p[4] is not None], route[-1][3])
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        self.place.update((int(place[0]), float(place[1])))
        self.told.update((*told[:9], now, *told[10:]))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + (min(self.idle_ms, L.ENDED_S * 1000) if told[7] else self.idle_ms))
        if events:
            yield L._events(key[0], events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.points, self.place, self.told):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def fixes_as_input(fixes: DataFrame) -> DataFrame:
    return fixes.select("ride_id", "ts", "event_id", "lon", "lat", "accuracy_m", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("distance_m"), F.lit(None).cast("string").alias("text"))


def ride_events(stream: DataFrame, routes: DataFrame | None = None, *, idle_minutes: int | None = 30) -> DataFrame:
    """A stream of INPUT rows -> events (see guidance.advance), with match and guidance in one operator.

    A row with idx is a point of its ride's route, any other a fix. ``routes`` (ride_id, idx, lon, lat, distance_m, text) are the routes known
    when the stream first starts: they enter the state once and are not read again after a restart; later ones come as
    rows of the stream, taken before the fixes of the same trigger. A point with a text is an instruction. Fixes of a ride without a route
    are passed over. A timer clears a ride's state ``idle_minutes`` after its last fix (None: kept), two minutes after
    it once the ride has arrived; a stream with timers ends by itself (availableNow) only without batches that
    have no data (spark.sql.streaming.noDataMicroBatches.enabled). The session's state store becomes RocksDB, so that state may exceed memory.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = None if routes is None else routes.select("ride_id", "idx", "lon", "lat", "distance_m", "text").groupBy("ride_id")
    idle = None if idle_minutes is None else idle_minutes * 60_000
    return stream.groupBy("ride_id").transformWithStateInPandas(Ride(idle), L.EVENTS, "Append", "None" if idle is None else "ProcessingTime", initialState=known)


def ride_events_batch(fixes: DataFrame, routes: DataFrame) -> DataFrame:
    """The same events from tables: the stateful match over each ride, then the guidance."""
    point = F.struct("idx", "lon", "lat", "distance_m", "text")
    per = routes.groupBy("ride_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    per = per.select("ride_id", F.transform("points", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["distance_m"].alias("distance_m"))).alias("route"), F.transform(F.filter("points", lambda p: p["text"].isNotNull()), lambda p: F.struct(p["distance_m"].alias("at_m"), p["text"].alias("text"))).alias("instructions"), F.array_max(F.transform("points", lambda p: p["distance_m"])).alias("end_m"))
    at = L.matched(fixes.join(per.select("ride_id", "route"), "ride_id")).select("ride_id", "event_id", "route_m", "off_m")
    return L.guide_batch(fixes.join(at, ["ride_id", "event_id"]).join(per.drop("route"), "ride_id"))
