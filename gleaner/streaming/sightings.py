"""What is known of each id, grown sighting by sighting, and whether it is still there.

A sighting says that a sweep has met an id at a time, perhaps with a slug, an address, a tab or a date. Sets grow, the newest
date and the shortest home slug stay. Sweeps follow one another at a fixed width; an id that a whole sweep has not met is
``gone`` at that sweep's end, and ``returned`` when a later one meets it. The stream holds this as state: facts with the first
names of each set, two maps for the names beyond, and a timer at the end of the sweep in which the id has to be met again. The batch form gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: A sighting; ``home``: the slug is that of the id's own page.
SIGHTING = "id long, seen_at timestamp, slug string, url string, home boolean, tab string, lastmod string"
FACTS = "seq long, slug string, url string, lastmod string, n_tabs long, n_aliases long, first_sweep long, last_sweep long, gone boolean, tabs array<string>, aliases array<string>"
#: Names of a set that are read and written with the facts, in one call; each one beyond is a call of its own.
HELD = 500
#: ``event``: new, seen (a batch has touched the id), gone or returned; ``at``: the beginning of the sweep that met the id, or
#: the end of the one that did not. ``seq`` counts an id's rows.
#: A call tells all that it found in one row, as lists (``events``, ``ats``), because a row from Python costs far more than one in the JVM.
TOLD = "id long, seq long, events array<string>, ats array<long>, slug string, url string, lastmod string, tabs array<string>, alias_count long, first_seen long, last_seen long, active boolean"
STATE = "id long, seq long, event string, at long, slug string, url string, lastmod string, tabs array<string>, alias_count long, first_seen long, last_seen long, active boolean"
TIMES = ("at", "first_seen", "last_seen")


class Known(StatefulProcessor):
    """The state of one id. ``width`` is a sweep's seconds."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", FACTS)
        self.tabs = handle.getMapState("tabs", "tab string", "there boolean")
        self.aliases = handle.getMapState("aliases", "slug string", "there boolean")

    def due(self, sweep: int) -> int:
        """When an id that this sweep has met is gone, if no later one meets it: the next one's end, in milliseconds."""
        return (sweep + 2) * self.width * 1000

    def joined(self, names: set[str], held: list[str], state) -> int:
        """How many names are new to a set; they are in it then."""
        new = 0
        for name in sorted(names.difference(held)):
            if len(held) < HELD:
                held.append(name)
            elif state.containsKey((name,)):
                continue
            else:
                state.updateValue((name,), (True,))
            new += 1
        return new

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        seed, tabs = initialState, []
        n = self.joined(set(seed.tabs or ()), tabs, self.tabs)
        self.facts.update((0, seed.slug or "", seed.url or "", "", n, seed.alias_count or 0, seed.sweep, seed.sweep, False, tabs, []))
        self.handle.registerTimer(self.due(seed.sweep))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sweeps, tabs, aliases, lastmod, homes = set(), set(), set(), "", set()
        for r in rows:  # whatever their number, a batch leaves few distinct values of an id
            sweeps.add(r.sweep)
            if r.slug:
                aliases.add(r.slug)
                if r.home:
                    homes.add((len(r.slug), r.slug, r.url or ""))
                    homes = {min(homes)}
            if r.tab:
                tabs.add(r.tab)
            lastmod = max(lastmod, r.lastmod or "")
        seen = self.facts.get()
        f = [*seen[:9], list(seen[9]), list(seen[10])] if seen is not None else [0, "", "", "", 0, 0, min(sweeps), None, False, [], []]
        f[4] += self.joined(tabs, f[9], self.tabs)
        f[5] += self.joined(aliases, f[10], self.aliases)
        for _, slug, url in homes:
            if not f[1] or (len(slug), slug, url) < (len(f[1]), f[1], f[2]):
                f[1], f[2] = slug, url
        f[3] = max(f[3], lastmod)
        events, was = [], f[7]
        for s in sorted(sweeps):
            if f[7] is None:
                events.append(("new", s))
            elif s > f[7] + 1:
                if not f[8]:
                    events.append(("gone", f[7] + 2))
                events.append(("returned", s))
            f[7], f[8] = s if f[7] is None else max(f[7], s), False if f[7] is None or s >= f[7] else f[8]
            f[6] = min(f[6], s)
        if was is not None and was != f[7] and not (seen is not None and seen[8]):
            self.handle.deleteTimer(self.due(was))
        if was != f[7]:
            self.handle.registerTimer(self.due(f[7]))
        events.append(("seen", f[7]))
        yield from self.told(key, f, events)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = self.facts.get()
        if seen is None:
            return
        f = [*seen[:9], list(seen[9]), list(seen[10])]
        if f[8] or expiredTimerInfo.getExpiryTimeInMs() != self.due(f[7]):
            return
        f[8] = True
        yield from self.told(key, f, [("gone", f[7] + 2)])

    def told(self, key: tuple, f: list, events: list[tuple[str, int]]) -> Iterator[Row]:
        tabs = sorted([*f[9], *(k[0] for k in self.tabs.keys())] if f[4] > len(f[9]) else f[9])
        names, ats = map(list, zip(*events))
        yield Row(id=key[0], seq=f[0], events=names, ats=ats, slug=f[1], url=f[2], lastmod=f[3], tabs=tabs, alias_count=f[5], first_seen=f[6], last_seen=f[7], active=not f[8])
        f[0] += len(events)
        self.facts.update(tuple(f))

    def close(self) -> None:
        pass


def grown(sightings: DataFrame, width: int, late: str = "0 seconds", seed: DataFrame | None = None) -> DataFrame:
    """The stream of an id's states (see ``STATE``; its ``TIMES`` are timestamps) from a stream of sightings; ``width``: seconds of a sweep. Sightings that
    come later than ``late`` after newer ones are dropped by the watermark. ``seed`` (id, slug, url, tabs, alias_count, sweep) is
    what storage knew when the stream first began. Needs the RocksDB state store: see :func:`started`."""
    keyed = sightings.where("id is not null and seen_at is not null").withColumn("sweep", sweep_of(width)).withWatermark("seen_at", late).groupBy("id")
    initial = None if seed is None else seed.groupBy("id")
    out = keyed.transformWithState(Known(width), TOLD, "Append", "EventTime", initial)
    out = out.select("*", F.posexplode("events").alias("_n", "event")).withColumns({"at": F.get("ats", F.col("_n")), "seq": F.col("seq") + F.col("_n") + 1})
    out = out.select(*(c.split()[0] for c in STATE.split(", ")))
    return out.withColumns({c: beginning(F.col(c), width) for c in TIMES})


def started(states: DataFrame, folder: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Drain what has been staged into Parquet files below ``folder``, and stop; a later start goes on from the checkpoint."""
    spark = states.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:  # of the state: they stay what they are at the first start
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return states.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest(states: DataFrame) -> DataFrame:
    """The last state of each id."""
    return states.groupBy("id").agg(F.max_by(F.struct(*(c for c in states.columns if c not in ("id", "event", "at", "seq"))), "seq").alias("s")).select("id", "s.*")


def transitions(states: DataFrame) -> DataFrame:
    return states.where("event <> 'seen'").select("id", "event", "at")


# ---- the same over all sightings at once ----


def sweep_of(width: int) -> Column:
    return F.floor(F.unix_timestamp("seen_at") / width)


def beginning(sweep: Column, width: int) -> Column:
    return F.timestamp_seconds(sweep * width)


def all_transitions(sightings: DataFrame, width: int, until: Column) -> DataFrame:
    """(id, event, at) up to a time: what :func:`transitions` has given when the watermark is there."""
    met = sightings.where("id is not null and seen_at is not null").select("id", sweep_of(width).alias("s")).distinct()
    w = Window.partitionBy("id").orderBy("s")
    met = met.withColumns({"was": F.lag("s").over(w), "then": F.lead("s").over(w)})
    start = met.select("id", F.when(F.col("was").isNull(), "new").when(F.col("s") > F.col("was") + 1, "returned").alias("event"), beginning(F.col("s"), width).alias("at"))
    end = beginning(F.col("s") + 2, width)
    gone = met.where((F.col("then") > F.col("s") + 1) | (F.col("then").isNull() & (end <= until))).select("id", F.lit("gone").alias("event"), end.alias("at"))
    return start.where("event is not null").unionByName(gone)


def all_states(sightings: DataFrame, width: int, until: Column) -> DataFrame:
    """What :func:`latest` has given when the watermark is at ``until``."""
    s = sightings.where("id is not null and seen_at is not null").withColumn("s", sweep_of(width))
    home = F.struct(F.length("slug").alias("n"), "slug", F.coalesce("url", F.lit("")).alias("url"))
    out = s.groupBy("id").agg(
        F.min(F.when(F.col("home") & (F.col("slug") != ""), home)).alias("h"), F.coalesce(F.max("lastmod"), F.lit("")).alias("lastmod"),
        F.array_sort(F.collect_set(F.nullif("tab", F.lit("")))).alias("tabs"), F.count_distinct(F.nullif("slug", F.lit(""))).alias("alias_count"),
        F.min("s").alias("a"), F.max("s").alias("z"),
    )
    return out.select(
        "id", F.coalesce("h.slug", F.lit("")).alias("slug"), F.coalesce("h.url", F.lit("")).alias("url"), "lastmod", "tabs", "alias_count",
        beginning(F.col("a"), width).alias("first_seen"), beginning(F.col("z"), width).alias("last_seen"), (beginning(F.col("z") + 2, width) > until).alias("active"),
    )
