"""The data source of landed snapshots: batch and stream give the same rows, and a restart repeats none."""

import json

import pytest

from rookery.sources import landed

COLUMNS = ("file", "event_id", "book", "market", "name", "price", "point")


def event(i, books=("dk", "fd")):
    outcomes = [{"name": "H", "price": -110, "point": -3.5 - i}, {"name": "A", "price": "n/a", "point": 3.5 + i}, {"price": 5}]
    return {"id": f"e{i}", "commence_time": "2024-09-01T00:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": [{"key": b, "last_update": "2024-08-31T12:00:00+02:00", "markets": [{"key": "spreads", "outcomes": outcomes}, {"key": "h2h"}]} for b in books]}


def land(folder, name, *lines):
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


@pytest.fixture
def folder(spark, tmp_path):
    landed.register(spark)
    place = tmp_path / "odds"
    place.mkdir()
    for i in range(5):
        land(place, f"odds-2024-08-3{i}.json", event(i), {"timestamp": f"2024-08-3{i % 2}T00:00:00Z", "data": event(10 + i, ("mgm",))}, "broken", "[1]", {"id": "empty"})
    land(place, ".odds-9.json", event(99))
    land(place, "odds-9.json.part", event(99))
    return place


def want(names):
    out = []
    for n in names:
        i = int(n[-6])
        for e, books in ((i, ("dk", "fd")), (10 + i, ("mgm",))):
            for b in books:
                k = e
                out += [(n, f"e{e}", b, "spreads", "H", -110.0, -3.5 - k), (n, f"e{e}", b, "spreads", "A", None, 3.5 + k)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_batch_reads_every_file_over_tasks(spark, folder):
    names = [f"odds-2024-08-3{i}.json" for i in range(5)]
    df = spark.read.format("landed_odds").option("files", 2).load(str(folder))
    assert df.rdd.getNumPartitions() == 3 and got(df) == want(names)
    assert {str(r.last_update) for r in df.collect()} == {"2024-08-31 10:00:00"} and {str(r.snapshot) for r in df.where("book = 'mgm'").collect()} == {"2024-08-30 00:00:00", "2024-08-31 00:00:00"}
    part = spark.read.format("landed_odds").option("since", names[0]).option("until", names[2]).load(str(folder))
    assert got(part) == want(names[1:3])
    assert spark.read.format("landed_odds").load(f"{folder}/none").count() == 0


def test_a_stream_gives_the_batch_rows_and_a_restart_repeats_none(spark, folder, tmp_path):
    def run():
        df = spark.readStream.format("landed_odds").load(str(folder))
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return got(spark.read.schema(landed.SCHEMA).parquet(f"{tmp_path}/out"))

    batch = lambda: got(spark.read.format("landed_odds").load(str(folder)))
    assert run() == batch()
    assert run() == batch()
    land(folder, "odds-2024-08-37.json", event(7), {"timestamp": "2024-08-31T00:00:00Z", "data": event(17, ("mgm",))})
    assert run() == batch() == want([*(f"odds-2024-08-3{i}.json" for i in range(5)), "odds-2024-08-37.json"])
