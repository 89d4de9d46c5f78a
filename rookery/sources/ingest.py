"""From landed files to keyed tables, a run at a time: only files that came since the last run are read.

Each feed lands JSON lines in a folder of its own. A run streams the files its checkpoint has not seen, reads fields by their paths from open
documents, sets aside the rows that cannot be used with the reason, merges the others into the feed's table and adds a row to the manifest: files, rows in, rows
kept, rows set aside by reason, and the feed's high-water mark. Rows are classified and counted in one pass (``observe``). A batch that is run again writes
the same quarantine and manifest rows in place of its own and merges the same rows, so nothing counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rookery.functions.nested import found, opened
from rookery.operators.keyed import KeyedTable
from rookery.sources.shared import discard, stored


@dataclass(frozen=True)
class Field:
    """A column's type and the paths it may stand at, of which the first that is not null counts. ``zero_is_none`` reads 0 as nothing."""

    kind: str
    paths: tuple[str, ...]
    required: bool = False
    zero_is_none: bool = False

    def value(self, document: Column) -> Column:
        v = F.coalesce(*[found(document, p, self.kind) for p in self.paths])
        return F.when(v != 0, v) if self.zero_is_none else v

    def given(self, document: Column) -> Column:
        """Whether any path holds something other than null."""
        return F.coalesce(*[found(document, p, "variant").isNotNull() & ~F.is_variant_null(found(document, p, "variant")) for p in self.paths], F.lit(False))


def field(kind: str, *paths: str, required: bool = False, zero_is_none: bool = False) -> Field:
    return Field(kind, paths, required, zero_is_none)


@dataclass(frozen=True)
class Feed:
    """What lands and what becomes of it. ``team`` names a column that is looked up in the aliases (alias, team_id) and gives ``team_id``; ``mark`` is the column of the high-water mark; of rows of a key the one of the greatest ``mark`` stays, the later batch's at a tie."""

    name: str
    fields: dict[str, Field]
    keys: tuple[str, ...]
    mark: str
    team: str | None = None

    def classified(self, lines: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
        """``value`` (the line), ``reason`` (null where it can be used) and the columns of each line."""
        doc = opened(F.col("value"))
        rows = lines.withColumn("_doc", doc)
        d = F.col("_doc")
        is_object = F.coalesce(F.schema_of_variant(d).startswith("OBJECT"), F.lit(False))
        rows = rows.withColumns({c: f.value(d) for c, f in self.fields.items()})
        reason = F.when(~is_object, "no object")
        for c, f in self.fields.items():
            lost = F.col(c).isNull() & f.given(d) if not f.zero_is_none else F.lit(False)
            reason = reason.when(lost, f"bad {c}")
            if f.required:
                reason = reason.when(F.col(c).isNull(), f"no {c}")
        rows = rows.withColumn("reason", reason).drop("_doc")
        if self.team:
            known = aliases.groupBy("alias").agg(F.min("team_id").alias("team_id"))
            rows = rows.join(known, F.col(self.team) == F.col("alias"), "left").drop("alias")
            rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("team_id").isNull(), "unmapped team")))
        return rows

    @property
    def reasons(self) -> list[str]:
        own = [f"bad {c}" for c, f in self.fields.items() if not f.zero_is_none] + [f"no {c}" for c, f in self.fields.items() if f.required]
        return ["no object", *own, *(["unmapped team"] if self.team else [])]


MANIFEST = "feed string, batch bigint, files bigint, rows_in bigint, rows_kept bigint, reasons map<string,bigint>, high_water string"


class Lake:
    """Tables, quarantine, manifest and checkpoints of all feeds below one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def table(self, feed: Feed) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/tables/{feed.name}", feed.keys, (feed.mark,), buckets=self.buckets)

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest/*/*")

    def quarantine(self, feed: Feed) -> DataFrame:
        """value, reason, file and batch of the rows set aside."""
        return self.spark.read.schema("value string, reason string, file string, batch bigint").json(f"{self.folder}/quarantine/{feed.name}/*")

    def marks(self) -> DataFrame:
        """The high-water mark of each feed."""
        return self.manifest().groupBy("feed").agg(F.max("high_water").alias("high_water"), F.sum("files").alias("files"), F.sum("rows_in").alias("rows_in"))

    def run(self, feed: Feed, landed: str, aliases: DataFrame | None = None, files: int = 1_000) -> None:
        """Takes in the files of ``landed`` that are new, ``files`` to a batch; a run without any does nothing."""

        def put(batch: DataFrame, number: int) -> None:
            spark, seen = batch.sparkSession, Observation()
            rows = feed.classified(batch, aliases)
            counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in feed.reasons]
            rows = rows.observe(seen, F.count("*").alias("rows in"), F.count(F.when(F.col("reason").isNull(), 1)).alias("rows kept"), F.max(F.when(F.col("reason").isNull(), F.col(feed.mark))).cast("string").alias("high water"), *counts)
            staged, path = stored(rows, f"ingest-{feed.name}")
            wanted = [c for c in staged.columns if c not in ("value", "reason", "file")]
            self.table(feed).merge(staged.where("reason is null").select(*wanted))
            bad = staged.where("reason is not null").select("value", "reason", "file", F.lit(number).cast("bigint").alias("batch"))
            bad.write.mode("overwrite").json(f"{self.folder}/quarantine/{feed.name}/{number}")
            got, n = seen.get, staged.agg(F.count_distinct("file")).first()[0]
            line = [(feed.name, number, n, got["rows in"], got["rows kept"], {r: got[r] for r in feed.reasons if got[r]}, got["high water"])]
            spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/{feed.name}/{number}")
            discard(spark, path)

        new = self.spark.readStream.option("maxFilesPerTrigger", files).text(landed).select("value", F.col("_metadata.file_path").alias("file"))
        query = new.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.folder}/checkpoints/{feed.name}").trigger(availableNow=True).start()
        query.awaitTermination()


#: Efficiency of a team in a game. The paths at which the provider has had each figure.
TEAM_GAME = Feed(
    "team_game",
    {
        "game_id": field("bigint", "$.gameId", required=True), "team": field("string", "$.team", required=True), "season": field("int", "$.season"), "week": field("int", "$.week"), "as_of": field("timestamp", "$.asOf"),
        **{c: field("double", *paths, zero_is_none=True) for c, paths in {
            "off_epa": ("$.offense.epa",), "off_sr": ("$.offense.successRate",), "iso_ppp_off": ("$.offense.explosiveness",), "line_yards_off": ("$.offense.lineYards",), "power_success": ("$.offense.powerSuccess",),
            "def_epa": ("$.defense.epa",), "def_sr": ("$.defense.successRate",), "iso_ppp_def": ("$.defense.explosiveness",), "stuff_rate": ("$.defense.stuffRate",),
            "run_epa": ("$.offense.rushingPlays.epa",), "pass_epa": ("$.offense.passingPlays.epa",), "run_sr": ("$.offense.rushingPlays.successRate",), "pass_sr": ("$.offense.passingPlays.successRate",),
            "early_down_epa": ("$.offense.firstDown.epa",), "late_down_epa": ("$.offense.secondDown.epa",), "avg_field_position": ("$.fieldPosition.averageStartingFieldPosition",),
        }.items()},
        **{f"ppo_{s}": field("double", *[f"$.{side}.{p}" for p in ("pointsPerOpportunity", "ppo", "pointsPerOpp")]) for s, side in (("off", "offense"), ("def", "defense"))},
        **{f"havoc{k}_{s}": field("double", *[f"$.{side}.havoc{p}" for p in paths]) for s, side in (("off", "offense"), ("def", "defense")) for k, paths in (("", (".total", ".havoc", "")), ("_front7", (".frontSeven", ".front7")), ("_db", (".db",)))},
    },
    ("game_id", "team_id"), "as_of", "team",
)

#: One statistic of a team's season, in the provider's order.
SEASON_STAT = Feed(
    "season_stat",
    {"season": field("int", "$.season", required=True), "team": field("string", "$.team", required=True), "category": field("string", "$.category"), "stat_name": field("string", "$.statName", required=True), "stat_value": field("string", "$.statValue"), "place": field("bigint", "$.place")},
    ("season", "team_id", "category", "stat_name"), "place", "team",
)

