"""State that ends by event time: leases, deduplication and freshness per key.

Each processor keeps a few typed values per key and one timer. The timer fires when the watermark has
passed it, whether or not a row of the key ever comes again; its handler emits what the end of the state
means and clears the state, so a key that falls silent costs nothing. What a row means never depends on
when the timer fires: a row that comes after the end, but before the watermark, is told so by its own
time. Results are therefore those of a batch over the same rows, with one exception that is part of the
rule: ends after the final watermark have not been reached yet.

Rows must have a watermark (``withWatermark``) on a timestamp column; ``us`` is that time in microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def milliseconds(us: int) -> int:
    """The first millisecond that is not before ``us``."""
    return -(-int(us) // 1000)


class Ending(StatefulProcessor):
    """One value ``kept`` of the given schema and one timer; ``None`` in :attr:`state` is no state."""

    schema = "at bigint"

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{self.schema}, ends bigint")

    def store(self, values: tuple, ends: int, before: tuple | None) -> None:
        """Keep ``values`` until ``ends`` (microseconds), moving the timer."""
        timer = milliseconds(ends)
        if before is None or before[-1] != timer:
            if before is not None:
                self.handle.deleteTimer(int(before[-1]))
            self.handle.registerTimer(timer)
        self.kept.update((*values, timer))

    def told(self, key: tuple, before: tuple | None, rows: list[Row]) -> tuple[list[Row], tuple, int]:
        """Rows to emit, the new values and when they end (microseconds)."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.kept.get()
        out, values, ends = self.told(key, before, list(rows))
        if before is None or values != tuple(before[:-1]):
            self.store(values, ends, before)
        yield from out

    def row(self, key: tuple, **columns) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.speaks:
            yield from self.ended(key, self.kept.get())
        self.kept.clear()

    #: Whether the end of a state means anything.
    speaks = False

    def ended(self, key: tuple, kept: tuple) -> list[Row]:
        return []

    def close(self) -> None:
        pass


class Leases(Ending):
    """Renewals (us) extend a lease; emits (keys, expired_at) when one runs out, renewed later or never.
    A renewal at the deadline itself is in time; one that is not later than the last counts for nothing."""

    def __init__(self, keys: list[str], lease: int) -> None:
        super().__init__(keys)
        self.lease = lease

    speaks = True

    def told(self, key: tuple, before: tuple | None, rows: list[Row]) -> tuple[list[Row], tuple, int]:
        last, out = None if before is None else before[0], []
        for us in sorted(row["us"] for row in rows):
            if last is not None and us > last + self.lease:
                out.append(self.row(key, expired_at=last + self.lease))
            last = us if last is None else max(last, us)
        return out, (last,), last + self.lease

    def ended(self, key: tuple, kept: tuple) -> list[Row]:
        return [self.row(key, expired_at=kept[0] + self.lease)]


class FirstDeliveries(Ending):
    """Emits (keys, us) of deliveries that are kept: the first one, then the first one ``horizon`` or more
    after the last kept one. The state of a key ends with its horizon."""

    def __init__(self, keys: list[str], horizon: int) -> None:
        super().__init__(keys)
        self.horizon = horizon

    def told(self, key: tuple, before: tuple | None, rows: list[Row]) -> tuple[list[Row], tuple, int]:
        last, out = None if before is None else before[0], []
        for us in sorted(row["us"] for row in rows):
            if last is None or us >= last + self.horizon:
                last = us
                out.append(self.row(key, us=us))
        return out, (last,), last + self.horizon


class Freshness(Ending):
    """Monotone reads: a message is taken if it is the first, goes on in the current boot, or starts a
    boot that was never left. Emits (keys, tick, accepted, confirmed_at). Silence of more than ``idle``
    ends what is known of a key, its list of left boots included; the next message is a first one."""

    schema = "at bigint, boot string, seq bigint, confirmed bigint, retired array<string>"

    def __init__(self, keys: list[str], idle: int) -> None:
        super().__init__(keys)
        self.idle = idle

    def told(self, key: tuple, before: tuple | None, rows: list[Row]) -> tuple[list[Row], tuple, int]:
        out = []
        at, boot, seq, confirmed, retired = (None, None, None, None, []) if before is None else (before[0], before[1], before[2], before[3], list(before[4]))
        for row in sorted(rows, key=lambda r: r["tick"]):
            us, its_boot, its_seq = row["us"], row["boot"], row["seq"]
            if at is not None and us - at > self.idle:
                boot, seq, confirmed, retired = None, None, None, []
            first = boot is None
            taken = first or (its_seq > seq if its_boot == boot else its_boot not in retired)
            if taken:
                if not first:
                    confirmed = us
                    if its_boot != boot:
                        retired.append(boot)
                boot, seq = its_boot, its_seq
            at = us
            out.append(self.row(key, tick=row["tick"], accepted=bool(taken), confirmed_at=confirmed))
        return out, (at, boot, seq, confirmed, retired), at + self.idle + 1


class Bundle(StatefulProcessor):
    """Many keys of an :class:`Ending` in one call: their states are one list, with one timer at its first end.

    A call costs some exchanges with the state store whatever it does, so few rows a key are dear one key at a
    time. Here a batch reads and writes the live states of a bundle at once; those that ended are gone."""

    def __init__(self, ending: Ending, schema: T.StructType) -> None:
        self.ending, self.schema, self.width = ending, schema, len(ending.keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.schema)

    def load(self) -> dict[tuple, tuple]:
        return {tuple(row[: self.width]): tuple(row[self.width :]) for row in self.kept.get()}

    def store(self, live: dict[tuple, tuple], timer: int | None) -> None:
        """Keep ``live``; ``timer`` is the one that is set."""
        first = min((values[-1] for values in live.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if live:
            self.kept.put([(*key, *values) for key, values in live.items()])
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        live, come = self.load(), {}
        timer = min((values[-1] for values in live.values()), default=None)
        for row in rows:
            come.setdefault(tuple(row[k] for k in self.ending.keys), []).append(row)
        for one, some in come.items():
            out, values, ends = self.ending.told(one, live.get(one), some)
            live[one] = (*values, milliseconds(ends))
            yield from out
        self.store(live, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        live, now = self.load(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for one in [k for k, values in live.items() if values[-1] <= now]:
            yield from self.ending.ended(one, live.pop(one))
        self.store(live, None)

    def close(self) -> None:
        pass


def ending(stream: DataFrame, processor: Ending, schema: str, bundles: int | None = None) -> DataFrame:
    """The rows that ``processor`` emits for the keys of ``stream``, which has a watermark. With ``bundles``
    keys are dealt by hash to that many calls a batch; it stays the same as long as a checkpoint is used."""
    if not bundles:
        return stream.groupBy(*processor.keys).transformWithState(processor, schema, "Append", "EventTime")
    held = T.StructType([*[stream.schema[k] for k in processor.keys], *T.StructType.fromDDL(f"{processor.schema}, ends bigint").fields])
    dealt = stream.withColumn("_bundle", F.pmod(F.xxhash64(*processor.keys), F.lit(bundles)))
    return dealt.groupBy("_bundle").transformWithState(Bundle(processor, held), schema, "Append", "EventTime")
