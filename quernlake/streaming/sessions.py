"""State of sessions on streams: rounds that close late, and the slot that rotates memories; each the same as its batch form."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions import cleaning as C
from ..functions import exprs as X

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """State with lists, maps and timers needs this store; the session's setting comes back afterwards."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


ROUNDS = "sid string, round long, first double, last double, n long, users long, why string"


def _due(at: float) -> int:
    """The first millisecond at which a watermark has reached ``at``."""
    return math.ceil(round(at * 1000, 3))


class _Rounds(StatefulProcessor):
    """Messages wait until the watermark has passed them, and are then taken in order; a timer closes what falls silent.

    One timer waits for the earliest held message, as the first that fires takes all that are due: what is held is read once
    for each batch, not once for each message.
    """

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at double, id string, role string")
        self.open = handle.getValueState("open", "round long, first double, last double, n long, users long, role string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.held.appendList([(float(a), str(i), str(r)) for a, i, r in zip(batch["at"], batch["id"], batch["role"])])
            first = batch["at"].min() if first is None else min(first, batch["at"].min())
        if first is not None:
            self.handle.registerTimer(_due(first))
        yield pd.DataFrame([], columns=[c.split()[0] for c in ROUNDS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        held = list(self.held.get()) if self.held.exists() else []
        ready = sorted(tuple(x) for x in held if x[0] <= now)
        left = [tuple(x) for x in held if x[0] > now]
        if ready:
            self.held.put(left) if left else self.held.clear()
        if left:
            self.handle.registerTimer(_due(min(left)[0]))
        number, first, last, n, users, before = tuple(self.open.get()) if self.open.exists() else (1, 0.0, 0.0, 0, 0, "")
        out = []
        for at, _, role in ready:
            why = "silent" if n and at - last > self.idle else "next" if n and role == "user" and before != "user" else ""
            if why:
                out.append((key[0], number, first, last, n, users, why))
                number, n, users = number + 1, 0, 0
            first, last, n, users, before = first if n else at, at, n + 1, users + (role == "user"), role
        if n and last + self.idle < now:
            out.append((key[0], number, first, last, n, users, "silent"))
            number, n, users = number + 1, 0, 0
        elif n and ready:
            self.handle.registerTimer(int((last + self.idle) * 1000) + 1)
        self.open.update((number, first, last, n, users, before))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROUNDS.split(", ")])

    def close(self) -> None:
        pass


def closed_rounds(messages: DataFrame, idle: float, late: str) -> DataFrame:
    """Rounds of a stream of messages (sid, id, role, ts) as they close: sid, round (from 1), first, last, n, users, why.

    A round ends before a user's message that follows another's (next), and after ``idle`` seconds without any (silent), for
    which no further message is needed. Messages up to ``late`` out of order are put in order first, so the rounds are the
    same however the stream is cut into batches. Null roles count as no user's.
    """
    rows = messages.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6).select("sid", "id", F.coalesce("role", F.lit("")).alias("role"), "ts", "at")
    return rows.groupBy("sid").transformWithStateInPandas(_Rounds(idle), ROUNDS, "append", "EventTime")


def closed_rounds_of(messages: DataFrame, idle: float, until: float) -> DataFrame:
    """closed_rounds() of a table, with the watermark at ``until`` (seconds)."""
    rows = messages.withColumn("at", F.unix_micros("ts") / 1e6).withColumn("role", F.coalesce("role", F.lit(""))).where(F.col("at") <= until)
    w = Window.partitionBy("sid").orderBy("at", "id")
    gap, before = F.col("at") - F.lag("at").over(w), F.lag("role").over(w)
    why = F.when(gap > idle, "silent").when((F.col("role") == "user") & (before != "user"), "next")
    marked = rows.withColumn("ended", why).withColumn("round", F.sum(F.col("ended").isNotNull().cast("long")).over(w) + 1)
    rounds = marked.groupBy("sid", "round").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.min(F.struct("at", "id", "ended"))["ended"].alias("began"))
    after = F.lead("began").over(Window.partitionBy("sid").orderBy("round"))
    over = F.coalesce(after, F.when(F.col("last") + idle < until, "silent"))
    return rounds.withColumn("why", over).where("why IS NOT NULL").select("sid", "round", "first", "last", "n", "users", "why")


class Slot(NamedTuple):
    """Settings of a rotating slot: memories shown at once; replies that one must survive unused; user turns of rest."""

    count: int = 2
    keep: int = 3
    rest: int = 4
    hits: int = 2


SHOWN = "sid string, turn long, id string, place int, again boolean"


def rotate(state: dict, slot: Slot, kind: str, turn: int, offered: list[tuple[str, str]], reply: str) -> list[tuple]:
    """One step of a session: an offer gives the memories to show (id, place, again), a reply says whether one was used.

    ``state``: batch [(id, text)], rounds, change, turn, hit (the turn of the last use), rest {id: turns}, shown and used
    {id: count}. A batch stays until one of it is used, or for ``keep`` replies; then the next is chosen from the offer:
    never shown first, then by the share of uses, then the least shown, then in the order offered. What was chosen rests
    for ``rest`` user turns. With nothing to choose the slot stays empty and asks again.
    """
    if kind == "reply":
        if state["change"] or not state["batch"] or state["hit"] == state["turn"]:
            return []
        used = [i for i, text in state["batch"] if X.used_in(text, reply, slot.hits)]
        for i in used:
            state["used"][i] = state["used"].get(i, 0) + 1
        if used:
            state |= {"hit": state["turn"], "change": True, "rounds": 0}
        else:
            state["rounds"] += 1
            state["change"] = state["rounds"] >= slot.keep
        return []
    new = turn != state["turn"]
    if new:
        state["turn"] = turn
        state["rest"] = {i: n - 1 for i, n in state["rest"].items() if n > 1}
    if not state["change"]:
        state["rounds"] += new
        return [(i, k, True) for k, (i, _) in enumerate(state["batch"])]
    free = [(i, text) for i, text in offered if i not in state["rest"]]
    shown, used = state["shown"], state["used"]

    def worth(k: int) -> tuple:
        i = free[k][0]
        n = shown.get(i, 0)
        return (n > 0, -used.get(i, 0) / n if n else 0.0, n, k)

    chosen = [free[k] for k in sorted(sorted(range(len(free)), key=worth)[: slot.count])]
    state |= {"batch": chosen, "rounds": 0, "change": not chosen}
    for i, _ in chosen:
        state["rest"][i] = slot.rest
        shown[i] = shown.get(i, 0) + 1
    return [(i, k, False) for k, (i, _) in enumerate(chosen)]


def _nothing() -> dict:
    return {"batch": [], "rounds": 0, "change": True, "turn": -1, "hit": -2, "rest": {}, "shown": {}, "used": {}}


def _rows(batches) -> list[tuple]:
    """The events of a session in order: at, place (an offer before the reply of its time), turn, offered, reply."""
    found = []
    for g in batches:
        for at, kind, turn, ids, texts, reply in zip(g["at"], g["kind"], g["turn"], g["ids"], g["texts"], g["reply"]):
            found.append((at, kind != "offer", int(turn), list(zip(ids, texts)) if ids is not None else [], reply or ""))
    return sorted(found, key=lambda x: x[:3])


class _Rotation(StatefulProcessor):
    """A session's slot in a value, its batch in a list, its counts and rests in maps, of which a step changes few."""

    def __init__(self, slot: Slot):
        self.slot = slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "rounds long, change boolean, turn long, hit long")
        self.batch = handle.getListState("batch", "id string, text string")
        self.maps = {n: handle.getMapState(n, "id string", "n long") for n in ("rest", "shown", "used")}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = _nothing()
        if self.now.exists():
            state |= dict(zip(("rounds", "change", "turn", "hit"), self.now.get()))
            state["batch"] = [tuple(x) for x in self.batch.get()] if self.batch.exists() else []
            state |= {n: {k[0]: v[0] for k, v in m.iterator()} for n, m in self.maps.items()}
        was, out = {n: dict(state[n]) for n in self.maps}, []
        for _, reply, turn, offered, text in _rows(rows):
            out += [(key[0], turn, *x) for x in rotate(state, self.slot, "reply" if reply else "offer", turn, offered, text)]
        self.now.update((state["rounds"], bool(state["change"]), state["turn"], state["hit"]))
        self.batch.put(state["batch"]) if state["batch"] else self.batch.clear()
        for n, m in self.maps.items():
            for i in was[n].keys() - state[n].keys():
                m.removeKey((i,))
            for i, v in state[n].items():
                if was[n].get(i) != v:
                    m.updateValue((i,), (v,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOWN.split(", ")])

    def close(self) -> None:
        pass


def _offers(events: DataFrame) -> DataFrame:
    """Events with offered texts that are more than media; ids and texts side by side."""
    good = F.filter("offered", lambda x: x.id.isNotNull() & ~C.media_only(x.text))
    return events.select("sid", "at", "kind", "turn", F.transform(good, lambda x: x.id).alias("ids"), F.transform(good, lambda x: F.coalesce(x.text, F.lit(""))).alias("texts"), "reply")


def rotation(events: DataFrame, slot: Slot = Slot()) -> DataFrame:
    """What the slot of each session shows, on a stream of events in the order of their time: sid, turn, id, place, again.

    events: sid, at (seconds), kind (offer or reply), turn (of the user; steps of one turn count once), offered
    array<struct<id, text>> best first, reply. Counts and rests live in the state store, one entry each.
    """
    return _offers(events).groupBy("sid").transformWithStateInPandas(_Rotation(slot), SHOWN, "append", "None")


def rotation_of(events: DataFrame, slot: Slot = Slot()) -> DataFrame:
    """rotation() of a table."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        state, out = _nothing(), []
        for _, reply, turn, offered, text in _rows([g]):
            out += [(key[0], turn, *x) for x in rotate(state, slot, "reply" if reply else "offer", turn, offered, text)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SHOWN.split(", ")])

    return _offers(events).groupBy("sid").applyInPandas(run, SHOWN)


def run_once(result: DataFrame, path: str) -> DataFrame:
    """Starts a stream on all there is, waits for its end, and reads what it wrote below ``path``; started again there, it goes on."""
    writer = result.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check")
    with rocks(result.sparkSession):
        writer.trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/out")
