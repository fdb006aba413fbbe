"""Stateful processors on streams; each agrees with its batch operator."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumasift.operators.ledger import STATUS
from lumasift.operators.similarity import band_layout

#: Waiting rows of one entry of a list state; numbers of a site's state that a call holds before it forgets them, and what a row counts.
AT_ONCE, HELD, ROW = 10_000, 1 << 22, 16


def _entries(rows: list[tuple]) -> list[tuple]:
    """Rows as entries of a list state, columns each: an entry costs the same for many rows as for one."""
    return [tuple(map(list, zip(*rows[k : k + AT_ONCE]))) for k in range(0, len(rows), AT_ONCE)]


def _cut(*columns: np.ndarray) -> list[tuple]:
    """As _entries, of arrays."""
    return [tuple(c[k : k + AT_ONCE].tolist() for c in columns) for k in range(0, len(columns[0]), AT_ONCE)]


def _rows(waiting) -> list[tuple]:
    return [row for entry in waiting.get() for row in zip(*entry)]


def _millis(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64) // 1000


class _Sprt(StatefulProcessor):
    """Wald's test of one key: scores wait until the watermark has passed them, and count in order of time."""

    def __init__(self, key: str, limits: tuple[float, float], steps: tuple[float, float], forget_ms: int):
        self.key, self.limits, self.steps, self.forget_ms = key, limits, steps, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.test = handle.getValueState("test", "total double, n long, settled boolean, last long")
        self.waiting = handle.getListState("waiting", "at array<long>, seq array<long>, p4 array<long>")

    def rows(self, found: list[tuple]) -> pd.DataFrame:
        # plain objects: texts of the newer string type arrive in chunks, which the sender of rows doesn't take
        return pd.DataFrame(found, columns=[self.key, "state", "used"], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        test = self.test.get()
        if test is None or not test[2]:
            new = [(_millis(p["ts"]), p["seq"].to_numpy(np.int64), p["p4"].to_numpy(np.int64)) for p in parts]
            self.waiting.appendList([entry for columns in new for entry in _cut(*columns)])
            self.handle.registerTimer(min(int(at.min()) for at, _, _ in new) + 1)
        yield from ()  # a table without rows would cost as much as one with some

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # one timer stands for all that waits: it settles what the watermark has passed, and the next one follows
        now = timerValues.getCurrentWatermarkInMs()
        total, n, settled, last = self.test.get() or (0.0, 0, False, 0)
        rows = sorted(_rows(self.waiting))
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        found = []
        for at, _, p4 in [] if settled else due:
            x = min(0.99, max(0.01, p4 / 10000.0))
            total, n, last = total + x * self.steps[0] + (1 - x) * self.steps[1], n + 1, at
            if total >= self.limits[0] or total <= self.limits[1]:
                settled = True
                found.append((key[0], "nsfw" if total >= self.limits[0] else "clean", n))
                break
        if not later and now >= last + self.forget_ms:  # nothing new for long: the key's state ends
            self.test.clear()
            self.waiting.clear()
        else:
            self.test.update((total, n, settled, last))
            if settled or not later:
                self.waiting.clear()
                self.handle.registerTimer(max(last, now) + self.forget_ms)
            else:
                self.waiting.put(_entries(later))
                self.handle.registerTimer(later[0][0] + 1)
        if found:
            yield self.rows(found)

    def close(self) -> None:
        pass


def sprt(events: DataFrame, key: str = "site", alpha: float = 0.05, beta: float = 0.05, p0: float = 0.5, p1: float = 0.9, late: str = "0 seconds", forget_hours: float = 24 * 90) -> DataFrame:
    """(key, state, used) once a key's test settles; later scores are absorbed.

    ``events``: key, seq, p4, ts.  Scores may come out of order by ``late``: they
    are taken in order of ts and seq once the watermark has passed them.  State
    is the running ratio, the count, whether it has settled, and waiting scores;
    it ends when a key has been quiet for ``forget_hours``, so a key that comes
    back later starts anew.  Needs a state store with timers (RocksDB).
    """
    limits = (math.log((1 - beta) / alpha), math.log(beta / (1 - alpha)))
    steps = (math.log(p1 / p0), math.log((1 - p1) / (1 - p0)))
    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(_Sprt(key, limits, steps, int(forget_hours * 3_600_000)), f"{key} {kind}, state string, used long", "append", "EventTime")


class _Held:
    """What a call has read of a site's maps and not yet written: a band is read once and written once, however many rows meet it."""

    def __init__(self, seen, sent):
        self.seen, self.sent = seen, sent
        self.old = (seen.exists(), sent.exists())
        self.shas: set[str] = set()
        self.bands: dict[tuple, tuple[array, int]] = {}
        self.read = 0

    def met(self, sha: str, at: int) -> bool:
        """Whether the content was seen; from now on it is."""
        if sha in self.shas:
            return True
        self.shas.add(sha)
        if self.old[0] and self.seen.containsKey((sha,)):
            return True
        self.seen.updateValue((sha,), (at,))
        return False

    def hashes(self, key: tuple) -> array:
        """Sent hashes of a band; those that are added are written later."""
        if key not in self.bands:
            known = array("q", self.sent.getValue(key)[0] if self.old[1] and self.sent.containsKey(key) else [])
            self.bands[key] = known, len(known)
            self.read += len(known) + 1
        return self.bands[key][0]

    def write(self) -> None:
        for key, (hashes, known) in self.bands.items():
            if len(hashes) > known:
                self.sent.updateValue(key, (hashes.tolist(),))
                self.bands[key] = hashes, len(hashes)

    def relieve(self) -> None:
        """Bounds the memory of a call, whatever the site's state."""
        self.read += ROW
        if self.read >= HELD:
            self.write()
            self.shas.clear()
            self.bands.clear()
            self.read, self.old = 0, (True, True)


class _Gate(StatefulProcessor):
    """One site's gate: what it has seen by content, and hashes that were sent by band."""

    def __init__(self, key: str, near_bits: int, least_px: int, forget_ms: int, in_order: bool, ttl_ms: int | None):
        self.key, self.near_bits, self.least_px, self.forget_ms, self.in_order, self.ttl_ms = key, near_bits, least_px, forget_ms, in_order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bands = band_layout(self.near_bits + 1)
        self.seen = handle.getMapState("seen", "sha string", "at long", self.ttl_ms)
        self.sent = handle.getMapState("sent", "band int, part long", "hashes array<long>", self.ttl_ms)
        if self.in_order:
            self.waiting = handle.getListState("waiting", "at array<long>, pos array<long>, sha array<string>, h array<long>, width array<long>, height array<long>")
            self.last = handle.getValueState("last", "at long")

    def decide(self, row: tuple, held: _Held) -> str:
        at, _, sha, h, width, height = row
        if held.met(sha, at):
            return "copy"
        if width < self.least_px and height < self.least_px:
            return "small"
        if h is None:
            return "sent"
        # hashes within d bits agree in one of d + 1 bands
        wide = h & (1 << 64) - 1
        keys = [(k, wide >> first & (1 << width) - 1) for k, (first, width) in enumerate(self.bands)]
        keys = [(k, part - (1 << 64) if part >= 1 << 63 else part) for k, part in keys]
        met = [held.hashes(key) for key in keys]
        if any((np.bitwise_count(np.frombuffer(hashes, np.uint64) ^ np.uint64(wide)) <= self.near_bits).any() for hashes in met if hashes):
            return "near"
        for hashes in met:
            hashes.append(h)
        return "sent"

    def rows(self, key, found: list[tuple]) -> pd.DataFrame:
        held, decided = _Held(self.seen, self.sent), []
        for r in found:
            decided.append((key[0], r[1], r[2], self.decide(r, held)))
            held.relieve()
        held.write()
        return pd.DataFrame(decided, columns=[self.key, "pos", "sha", "decision"], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        at = _millis(new["ts"])
        found = [(int(t), int(p), str(s), None if pd.isna(h) else int(h), int(w), int(v)) for t, p, s, h, w, v in zip(at, new["pos"], new["sha"], new["h"], new["width"], new["height"])]
        if not self.in_order:
            yield self.rows(key, sorted(found, key=lambda r: r[:2]))
            return
        self.waiting.appendList(_entries(found))
        self.handle.registerTimer(int(at.min()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else 0
        rows = sorted(_rows(self.waiting), key=lambda r: r[:2])
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        runs: list[list[tuple]] = [[]]
        for row in due:
            if last and row[0] >= last + self.forget_ms:  # quiet for long before this row
                runs.append([])
            runs[-1].append(row)
            last = max(last, row[0])
        out = self.rows(key, runs[0])
        for run in runs[1:]:
            self.seen.clear()
            self.sent.clear()
            out = pd.concat([out, self.rows(key, run)])
        self.waiting.clear()
        if later:
            self.waiting.put(_entries(later))
            self.handle.registerTimer(later[0][0] + 1)
            self.last.update((last,))
        elif now >= last + self.forget_ms:  # nothing new for long: the site's state ends
            for state in (self.seen, self.sent, self.last):
                state.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(max(last, now) + self.forget_ms)
        yield out

    def close(self) -> None:
        pass


def send_gate(images: DataFrame, site: str = "site", least_px: int = 200, near_bits: int = 4, late: str | None = "0 seconds", forget_hours: float = 24 * 90) -> DataFrame:
    """(site, pos, sha, decision) as sequential.send_gate has them: sent, copy, small or near.

    ``images``: site, pos, sha, h, width, height, ts.  With ``late`` rows wait
    until the watermark has passed them and are decided in order of ts and pos;
    a site's state ends when it has been quiet for ``forget_hours``.  Without
    ``late`` rows are decided as they come, in order within a batch, and what the
    gate remembers of an image lasts ``forget_hours`` of processing time.
    A site's state is a map of its contents and one of the bands of sent hashes,
    in the state store (RocksDB), never one object.
    """
    kind = images.schema[site].dataType.simpleString()
    images = images.withColumn("h", F.col("h").cast("string"))  # digits: longs beside nulls would lose bits in pandas
    forget_ms = int(forget_hours * 3_600_000)
    schema = f"{site} {kind}, pos long, sha string, decision string"
    if late is None:
        return images.groupBy(site).transformWithStateInPandas(_Gate(site, near_bits, least_px, forget_ms, False, forget_ms), schema, "append", "ProcessingTime")
    return images.withWatermark("ts", late).groupBy(site).transformWithStateInPandas(_Gate(site, near_bits, least_px, forget_ms, True, None), schema, "append", "EventTime")


class _Reliability(StatefulProcessor):
    """A provider's faded sums as of its newest time."""

    def __init__(self, half_life: float):
        self.half_life = half_life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "good double, bad double, n long, anchor double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        good, bad, n, anchor = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0, None)
        for part in rows:
            t, right = part["t"].to_numpy(float), part["correct"].to_numpy(bool)
            newest = float(t.max()) if anchor is None else max(anchor, float(t.max()))
            kept = 1.0 if anchor is None else 0.5 ** ((newest - anchor) / self.half_life)
            # rows that come late are older than the anchor, and fade to it
            w = 0.5 ** ((newest - t) / self.half_life)
            good, bad, n, anchor = good * kept + float(w[right].sum()), bad * kept + float(w[~right].sum()), n + len(t), newest
        self.sums.update((good, bad, n, anchor))
        yield pd.DataFrame([(key[0], good, bad, n, anchor)], columns=["provider", "good", "bad", "n", "anchor"], dtype=object)

    def close(self) -> None:
        pass


def reliability(outcomes: DataFrame, half_life: float) -> DataFrame:
    """After each batch (update mode) provider, good, bad, n, anchor, as sequential.bayes_checkpoint has them, each as of its own anchor.

    ``outcomes``: provider, correct, t.  Rows may come in any order: the anchor
    never moves back, and a row before it counts as faded.
    """
    kind = outcomes.schema["provider"].dataType.simpleString()
    return outcomes.groupBy("provider").transformWithStateInPandas(_Reliability(half_life), f"provider {kind}, good double, bad double, n long, anchor double", "update", "None")


def sessions(events: DataFrame) -> DataFrame:
    """Running groups after each batch (update mode): name, scans, agg_max, last_agg, hits.

    ``events``: name, agg4, hits, seq.  Late rows count, but the last value
    never goes back to an older one.
    """

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scans, top, last, last_seq, hits = state.get if state.exists else (0, 0, 0, -1, 0)
        for part in parts:
            scans += len(part)
            top = max(top, int(part["agg4"].max()))
            hits += int(part["hits"].sum())
            newest = part.loc[part["seq"].idxmax()]
            if newest["seq"] > last_seq:
                last, last_seq = int(newest["agg4"]), int(newest["seq"])
        state.update((scans, top, last, last_seq, hits))
        yield pd.DataFrame({"name": [k[0]], "scans": [scans], "agg_max": [top], "last_agg": [last], "hits": [hits]})

    kind = events.schema["name"].dataType.simpleString()
    return events.groupBy("name").applyInPandasWithState(step, f"name {kind}, scans long, agg_max long, last_agg long, hits long", "scans long, top long, last long, last_seq long, hits long", "update", GroupStateTimeout.NoTimeout)


def ledger_fold(events: DataFrame) -> DataFrame:
    """Status of each entry after each batch (update mode): entry_id, status, events.

    ``events``: entry_id, seq, event_type.
    """

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, at, n = state.get if state.exists else (None, -1, 0)
        for part in parts:
            n += len(part)
            for seq, kind in zip(part["seq"], part["event_type"]):
                if kind in STATUS and seq > at:
                    status, at = STATUS[kind], int(seq)
        state.update((status, at, n))
        yield pd.DataFrame({"entry_id": [k[0]], "status": [status], "events": [n]})

    return events.groupBy("entry_id").applyInPandasWithState(step, "entry_id long, status string, events long", "status string, at long, n long", "update", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, time: str, kind: str, every: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by window and kind; windows are final once the watermark has passed them.  ``every``: a length, or a length and a step."""
    length, _, step = every.partition("/")
    window = F.window(time, length.strip(), step.strip()) if step else F.window(time, length)
    return events.withWatermark(time, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def quiet_sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """key, start, end, n of runs of events without a gap; final once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, time: str, keys: list[str], late: str = "30 minutes") -> DataFrame:
    """Rows whose keys haven't been seen within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
