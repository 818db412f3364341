"""The stream of what is known of ids against the batch form, in several batches and after restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import sightings as S

DAY = 86_400
FIRST = datetime.datetime(2024, 1, 1)


def rows(seed):
    """Sightings of 30 days, day by day; ids pause for a while, some never come back."""
    rnd = random.Random(seed)
    out = []
    for day in range(30):
        for i in range(60):
            if (day // (1 + i % 7)) % 2 == 0 and not (i % 10 == 3 and day > 8):
                for _ in range(rnd.randint(1, 3)):
                    slug = rnd.choice(["", None, f"s{i}", f"s{i}-long", f"t{i}"])
                    out.append((i, FIRST + datetime.timedelta(days=day, seconds=rnd.randint(0, DAY - 1)), slug, f"/{slug}", rnd.random() < 0.5, rnd.choice(["fees", "courses", None, ""]), f"2024-01-{rnd.randint(1, 28):02}"))
    out += [(None, FIRST, "x", None, True, None, None), (7, None, "x", None, True, None, None), (999, FIRST + datetime.timedelta(days=29, hours=23), None, None, None, None, None)]
    return sorted(out, key=lambda r: r[1] or FIRST)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("cuts", [[30], [3, 7, 8, 20, 30]])
def test_stream_equals_batch_also_after_restarts(spark, tmp_path, cuts):
    data = rows(1)
    begin = 0
    for day in cuts:  # files come between the starts; each start goes on from the checkpoint
        part = [r for r in data if begin <= ((r[1] or FIRST) - FIRST).days < day]
        spark.createDataFrame(part, S.SIGHTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "staged"))
        stream = spark.readStream.schema(S.SIGHTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "staged"))
        S.started(S.grown(stream, DAY), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 2).awaitTermination()
        begin = day
    states = spark.read.parquet(str(tmp_path / "out"))
    whole = spark.createDataFrame(data, S.SIGHTING)
    until = F.lit(max(r[1] for r in data if r[1]))
    assert plain(S.transitions(states)) == plain(S.all_transitions(whole, DAY, until))
    last, want = S.latest(states), S.all_states(whole, DAY, until)
    assert plain(last.select(*want.columns)) == plain(want)
    events = {r.event for r in states.select("event").distinct().collect()}
    assert events == {"new", "seen", "gone", "returned"}


def test_what_storage_knew_is_not_new(spark, tmp_path):
    data = [(1, FIRST + datetime.timedelta(days=d), "one-longer", "/l", True, "fees", "") for d in (0, 5)]
    for k, r in enumerate(data):
        spark.createDataFrame([r], S.SIGHTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "staged"))
    sweep = int(FIRST.timestamp()) // DAY - 1
    seed = spark.createDataFrame([(1, "one", "/one", ["courses"], 4, sweep), (2, "two", "/two", None, 1, sweep)], "id long, slug string, url string, tabs array<string>, alias_count long, sweep long")
    stream = spark.readStream.schema(S.SIGHTING).parquet(str(tmp_path / "staged"))
    S.started(S.grown(stream, DAY, seed=seed), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 2).awaitTermination()
    states = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.event, (r.at - FIRST).days) for r in states.where("id = 1 and event <> 'seen'").orderBy("seq").collect()] == [("gone", 2), ("returned", 5)]
    one = S.latest(states).where("id = 1").first()
    assert (one.slug, one.url, one.tabs, one.alias_count, one.active) == ("one", "/one", ["courses", "fees"], 5, True)
    assert [r.event for r in states.where("id = 2").collect()] == ["gone"]


def test_a_set_is_one_call_and_goes_on_in_a_map():
    """What is held with the facts needs no call for each name; beyond that no name is lost or counted twice."""
    from types import SimpleNamespace

    class State:
        def __init__(self):
            self.calls, self.names = 0, {}

        def containsKey(self, name):
            self.calls += 1
            return name in self.names

        def updateValue(self, name, value):
            self.calls += 1
            self.names[name] = value

        def keys(self):
            return iter(self.names)

    class Facts:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    known = S.Known(DAY)
    known.handle = SimpleNamespace(registerTimer=lambda at: None, deleteTimer=lambda at: None)
    known.facts, known.tabs, known.aliases = Facts(), State(), State()
    seen = lambda names: [SimpleNamespace(sweep=1, slug=f"s{i}", url="", home=False, tab=f"t{i}", lastmod="") for i in names]
    out = list(known.handleInputRows((1,), seen(range(S.HELD)), None))
    assert (out[-1].alias_count, len(out[-1].tabs), known.tabs.calls + known.aliases.calls) == (S.HELD, S.HELD, 0)
    assert (len(out), out[-1].events, out[-1].ats) == (1, ["new", "seen"], [1, 1])
    for _ in range(2):
        out = list(known.handleInputRows((1,), seen(range(S.HELD + 20)), None))
        assert out[-1].alias_count == S.HELD + 20 and out[-1].tabs == sorted(f"t{i}" for i in range(S.HELD + 20))
    assert len(known.aliases.names) == 20


def test_names_beyond_those_held_in_a_stream(spark, tmp_path):
    many = S.HELD + 30
    data = [(1, FIRST + datetime.timedelta(days=d), f"s{i}", "/", True, f"t{i}", "") for d in range(2) for i in range(many)]
    for d in range(2):
        spark.createDataFrame(data[d * many :][:many], S.SIGHTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "staged"))
    stream = spark.readStream.schema(S.SIGHTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "staged"))
    S.started(S.grown(stream, DAY), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 2).awaitTermination()
    last = S.latest(spark.read.parquet(str(tmp_path / "out"))).first()
    assert last.alias_count == many and list(last.tabs) == sorted(f"t{i}" for i in range(many))
