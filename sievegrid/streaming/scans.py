"""Scans of sources as one stateful operator: ledger, barrier, carry-over, full cycles, attempt caps and intervals.

All that happens to a source comes in one stream of events, control events included, and each source's
state moves with it in order:

* SEEN (url, mark): the ledger takes the sighting; VERIFY goes out with a reason (0 new, 1 changed, 2 not
  verified, 3 due) unless the url has failed ``attempts`` times with this mark.
* VERIFIED, FAILED (url): success stages the url and lifts its own barrier only; failure raises it.
* SCAN_END (bucket): once per bucket. What is older than ``carry_s`` falls out of barrier and stage. If any
  barrier stands, everything staged is HELD; else each staged url is RELEASED. A quiet scan (nothing to
  verify, nothing staged) doubles the INTERVAL up to its bound, any other sets it back.
* FULL_CYCLE: speaks for the whole source; stage and barrier are cleared.

``outcomes`` is the batch form and ``outcome_stream`` the streaming one; both put every event through
``step``. The stream's state is Spark's: values and maps in the state store, an event-time timer that
forgets a source ``forget_s`` after its last event. A map holds one short row per url and is read by key, so
a source of very many urls costs its own events, not its state.

Defined results: events of one source are taken in order of (at_s, seq); of an unknown kind they are
IGNORED; a null url or bucket counts as ''. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "source string, seq long, at_s long, kind string, url string, mark string, bucket string"
OUTCOME = "source string, seq long, at_s long, outcome string, url string, detail long"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
#: Setting that stateful operators of this kind need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class Rules:
    """Times in seconds."""

    due_s: int = 86_400
    carry_s: int = 48 * 3600
    base_s: int = 900
    most_s: int = 14_400
    attempts: int = 2
    forget_s: int = 45 * 86_400


@dataclass
class Source:
    """One source's state. ledger: url to (mark, seen, verified at, verified mark, failures); stage: url to (mark, at); barrier: url to (at,)."""

    ledger: MutableMapping = field(default_factory=dict)
    stage: MutableMapping = field(default_factory=dict)
    barrier: MutableMapping = field(default_factory=dict)
    bucket: str | None = None
    interval: int = 0
    asked: int = 0
    last: int | None = None


def step(s: Source, kind: str, at: int, url: str, mark: str, bucket: str, rules: Rules) -> list[tuple[str, str, int | None]]:
    """What one event does to a source: (outcome, url, detail) rows."""
    if s.last is not None and at - s.last > rules.forget_s:
        for part in (s.ledger, s.stage, s.barrier):
            part.clear()
        s.bucket, s.interval, s.asked = None, 0, 0
    s.last = at
    if kind == "SEEN":
        return _seen(s, at, url, mark, rules)
    if kind in ("VERIFIED", "FAILED"):
        known = s.ledger.get(url) or (mark, at, None, None, 0)
        if kind == "VERIFIED":
            s.ledger[url] = (known[0], known[1], at, known[0], 0)
            s.stage[url] = (known[0], at)
            s.barrier.pop(url, None)
        else:
            s.ledger[url] = (*known[:4], known[4] + 1)
            s.barrier[url] = (at,)
        return []
    if kind == "SCAN_END":
        return _scan_end(s, at, bucket, rules)
    if kind == "FULL_CYCLE":
        s.stage.clear()
        s.barrier.clear()
        return [("CLEARED", "", None)]
    return [("IGNORED", url, None)]


def _seen(s: Source, at: int, url: str, mark: str, rules: Rules) -> list[tuple[str, str, int | None]]:
    known = s.ledger.get(url)
    if known is None:
        reason, failures = 0, 0
        s.ledger[url] = (mark, at, None, None, 0)
    else:
        had, _, verified_at, verified, failures = known
        failures = failures if had == mark else 0
        reason = 1 if had != mark else 2 if verified != mark else 3 if at - verified_at >= rules.due_s else None
        s.ledger[url] = (mark, at, verified_at, verified, failures)
    if reason is None:
        return []
    if failures >= rules.attempts:
        return [("EXHAUSTED", url, failures)]
    s.asked += 1
    return [("VERIFY", url, reason)]


def _scan_end(s: Source, at: int, bucket: str, rules: Rules) -> list[tuple[str, str, int | None]]:
    if bucket == s.bucket:
        return [("REPEATED", "", None)]
    s.bucket = bucket
    for url in [u for u, (since,) in s.barrier.items() if at - since > rules.carry_s]:
        del s.barrier[url]
    for url in [u for u, (_, since) in s.stage.items() if at - since > rules.carry_s]:
        del s.stage[url]
    staged = sorted(s.stage)
    quiet = not s.asked and not staged and not s.barrier
    s.interval = min((s.interval or rules.base_s) * 2, rules.most_s) if quiet else rules.base_s
    s.asked = 0
    if next(iter(s.barrier), None) is not None:
        out: list[tuple[str, str, int | None]] = [("HELD", "", len(staged))]
    else:
        out = [("RELEASED", url, s.stage[url][1]) for url in staged]
        s.stage.clear()
    return [*out, ("INTERVAL", "", s.interval)]


def _event_columns(df: DataFrame) -> DataFrame:
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("url", "mark", "bucket")]
    return df.select("source", "seq", "at_s", F.coalesce("kind", F.lit("")).alias("kind"), *texts)


def outcomes(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The batch form: each task walks its sources in order and holds one source's state."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            rows = []
            for source, seq, t, kind, url, mark, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or source != at:
                    at, state = source, Source()
                rows += [(source, seq, t, *out) for out in step(state, kind, t, url, mark, bucket, rules)]
            arrays = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(list(a), k) for a, k in zip(arrays, kinds, strict=True)], [c.split()[0] for c in OUTCOME.split(", ")])

    return _event_columns(df).select(_COLUMNS).repartition("source").sortWithinPartitions("source", "at_s", "seq").mapInArrow(walk, OUTCOME)


class _Stored(MutableMapping):
    """A map of the state store as a mapping of strings to tuples."""

    def __init__(self, state):
        self._state = state

    def __getitem__(self, key):
        value = self._state.getValue((key,)) if self._state.containsKey((key,)) else None
        if value is None:
            raise KeyError(key)
        return tuple(value)

    def __setitem__(self, key, value):
        self._state.updateValue((key,), tuple(value))

    def __delitem__(self, key):
        self._state.removeKey((key,))

    def __iter__(self):
        return iter([k[0] for k in self._state.keys()])

    def __len__(self):
        return sum(1 for _ in self._state.keys())

    def items(self):
        return [(k[0], tuple(v)) for k, v in self._state.iterator()]

    def clear(self):
        self._state.clear()


class SourceScans(StatefulProcessor):
    """Puts the events of each micro-batch, in order, through step."""

    def __init__(self, rules: Rules):
        self._rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._ledger = handle.getMapState("ledger", "url string", "mark string, seen long, verified_at long, verified string, failures long")
        self._stage = handle.getMapState("stage", "url string", "mark string, at long")
        self._barrier = handle.getMapState("barrier", "url string", "at long")
        self._rest = handle.getValueState("rest", "bucket string, interval long, asked long, last long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        state = Source(_Stored(self._ledger), _Stored(self._stage), _Stored(self._barrier))
        if self._rest.exists():
            state.bucket, state.interval, state.asked, state.last = self._rest.get()
        events = pd.concat(list(rows)).sort_values(["at_s", "seq"], kind="stable")
        out = []
        for seq, t, kind, url, mark, bucket in zip(*(events[c].tolist() for c in _COLUMNS[1:]), strict=True):
            out += [(key[0], seq, t, *x) for x in step(state, kind, t, url, mark, bucket, self._rules)]
        self._rest.update((state.bucket, state.interval, state.asked, state.last))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer((state.last + self._rules.forget_s) * 1000 + 1000)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])
        yield frame.astype({"detail": "Int64"})

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        for part in (self._ledger, self._stage, self._barrier, self._rest):
            part.clear()
        return iter([])

    def close(self) -> None:
        pass


def outcome_stream(stream: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """The streaming form. The session needs STATE_STORE; late: how much later than others an event may come."""
    timed = _event_columns(stream).withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", late)
    return timed.groupBy("source").transformWithStateInPandas(SourceScans(rules), OUTCOME, "Append", "EventTime")
