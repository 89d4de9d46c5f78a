"""Queries on keyed tables, incremental ingests, streams and catalogues of names, over what Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import catalogue
from rookery.operators.keyed import KeyedTable
from rookery.plans.market import SPLIT, _halves
from rookery.plans.registry import kicks, query, quotes, rounded, st
from rookery.session import table
from rookery.sources import files
from rookery.sources.ingest import Feed, Lake, field
from rookery.sources.shared import fresh
from rookery.streaming import closing
from rookery.streaming.quotes import stream


@query(f"with {SPLIT}, m as (select * from n union all select o.* from o left join n using (game, book) where n.line is null), d as (select m.* from m left join n using (game, book) where not coalesce(n.line > 50, false)) select * from d union all select o.* from o left join d using (game, book) where d.line is null")
def keyed_quotes(spark, d):
    """A keyed table through a merge that is run twice, a delete and an insert of what is missing."""
    old, new = _halves(spark, d)
    t = KeyedTable(spark, fresh(spark, "keyed-quotes"), ("game", "book"), buckets=16).create(old)
    t.merge(new)
    t.merge(new)
    t.delete(new.where("line > 50"))
    t.insert(old)
    return t.read()


#: Events as a provider lands them: values that are no numbers, teams that nobody knows, lines that are no objects.
_LINE = """case when event_id % 97 = 0 then '[' || event_id || ']' else '{"id":' || event_id || ',"team":"t' || (user_id % 50) || '","at":' || epoch || ',"value":' || case when event_id % 11 = 0 then '"n/a"' else cast(cast(floor(value) as bigint) as STRINGTYPE) end || '}' end"""
_FEED = Feed("events", {"id": field("bigint", "$.id", required=True), "team": field("string", "$.team"), "at": field("bigint", "$.at"), "value": field("double", "$.value", "$.number")}, ("team_id", "id"), "at", "team")
_KIND = "case when event_id % 97 = 0 then 'no object' when event_id % 11 = 0 then 'bad value' when user_id % 50 >= 40 then 'unmapped team' end"


@query(f"""with e as (select *, cast(floor(epoch_us(ts) / 1000000) as bigint) as epoch, {_KIND} as reason, case when day(ts) <= 10 then 0 when day(ts) <= 20 then 1 else 2 end as run from events ),
  r as (select run, coalesce(reason, 'kept') as outcome, count(*) as n, max(case when reason is null then epoch end) as high_water from e group by 1, 2), a as (select run, sum(n)::bigint as rows_in, cast(max(high_water) as varchar) as high_water from r group by 1)
  select cast(run as bigint) as batch, outcome, n, rows_in, a.high_water, (select count(*) from e where reason is null) as stored from r join a using (run)""")
def ingest_runs(spark, d):
    """Three drops of files, each followed by a run, and a run without new files: the manifest's rows by outcome, and the rows that the feed's table holds."""
    place = fresh(spark, "ingest")
    lake, aliases = Lake(spark, f"{place}/lake", 16), spark.range(40).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("alias"), F.col("id").alias("team_id"))
    e = table(spark, d, "events").withColumn("epoch", F.floor(F.unix_micros("ts") / 1_000_000))
    for drop in ("day(ts) <= 10", "day(ts) > 10 and day(ts) <= 20", "day(ts) > 20"):
        e.where(drop).select(F.expr(_LINE.replace("STRINGTYPE", "string"))).write.mode("append").text(f"{place}/landed")
        lake.run(_FEED, f"{place}/landed", aliases)
    lake.run(_FEED, f"{place}/landed", aliases)
    held = lake.table(_FEED).read().agg(F.count("*").alias("stored"))
    m = lake.manifest()
    outcomes = m.select("batch", "rows_in", "high_water", F.explode(F.map_concat("reasons", F.create_map(F.lit("kept"), "rows_kept"))).alias("outcome", "n"))
    return outcomes.where("n > 0").crossJoin(F.broadcast(held))  # one row


@query("with l as (select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'R' then 'Pass Yards' when l_returnflag = 'A' then ' pass yards ' else 'Plays' end as stat_name, case when l_suppkey % 5 = 0 then null else l_quantity end as v from lineitem) select l_orderkey, arg_max(v, struct_pack(a := l_linenumber, b := l_partkey)) filter (where v is not null and stat_name <> 'Plays') as pass_yards, arg_max(v, struct_pack(a := l_linenumber, b := l_partkey)) filter (where v is not null and stat_name = 'Plays') as plays from l group by 1")
def last_numbers(spark, d):
    """Long statistics to columns: of each the last value that is a number; of lines with the same number and part the one that stands first in the table."""
    name = F.when(F.col("l_returnflag") == "R", "Pass Yards").when(F.col("l_returnflag") == "A", " pass yards ").otherwise("Plays")
    value = F.when(F.col("l_suppkey") % 5 == 0, F.when(F.col("l_suppkey") % 2 == 0, "n/a")).otherwise(F.col("l_quantity").cast("string"))
    long = table(spark, d, "lineitem").withColumns({"stat_name": name, "stat_value": value, "_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    return files.pivoted(long, ["l_orderkey"], "stat_name", "stat_value", ["pass_yards", "plays"], ["l_linenumber", "l_partkey"], ("_file", "_row"))


@query("with k as (select game, min(kick) as kick from kicks group by 1), a as (select k.game, q.line, q.ts, row_number() over (partition by k.game order by q.ts desc, q.quote_id desc) as n from k join quotes q on q.game = k.game and q.ts <= k.kick) select k.game, a.line, a.ts from k left join a on a.game = k.game and a.n = 1")
def streamed_closing(spark, d):
    """Each game's closing quote by a stream over quotes that land out of order, and the correction for those that were too late."""
    place = fresh(spark, "closing")
    q = quotes(spark, d).select("game", "ts", "quote_id", "line")
    shuffled = F.unix_micros("ts") + (F.xxhash64("quote_id") % 86_400) * 1_000_000
    q.repartitionByRange(6, shuffled).write.parquet(f"{place}/landed")
    k = kicks(spark, d).groupBy("game").agg(F.min("kick").alias("kick"))
    landed = stream(spark, f"{place}/landed", "game bigint, ts timestamp, quote_id bigint, line double", files=2)
    closed = closing.closing(landed, k, late="1 day", live=400 * 86_400)
    closed.writeStream.format("parquet").option("path", f"{place}/closed").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(closing.CLOSED).parquet(f"{place}/closed")
    return closing.corrected(done, spark.read.schema(q.schema).parquet(f"{place}/landed"), k)


_SUFFIX = lambda n: f"case when ({n}) % 4 = 0 then ' State' when ({n}) % 4 = 1 then ' Tech' when ({n}) % 4 = 2 then ' A&M' else '' end"
_TEAMS = f"select min(p_partkey) as team_id, team from (select p_partkey, p_name || ' ' || p_brand || {_SUFFIX('p_size')} as team from part) group by team"
_NAMES = f"select distinct 'The ' || p_brand || ' ' || p_name || {_SUFFIX('p_size + case when p_partkey % 3 = 0 then 1 else 0 end')} || case when p_partkey % 5 = 0 then ' University' when p_partkey % 5 = 1 then ' Extra' else '' end as name from part"
_NORM = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s-]', '', 'g'), '\b(university|univ|college|the|football)\b', '', 'g'), '\s+', ' ', 'g'))"
_TOKENS = lambda x: f"list_distinct(list_filter(string_split({_NORM(x)}, ' '), lambda w: w <> ''))"


@query(rf"""with t as (select *, {_TOKENS('team')} as b, lower(team) as low from ({_TEAMS})), n as (select *, {_TOKENS('name')} as a, lower(name) as low from ({_NAMES})),
  s as (select name, team_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as score from n join t on regexp_matches(n.low, '\bstate\b') = contains(t.low, 'state') and regexp_matches(n.low, '\btech\b') = contains(t.low, 'tech') and not (regexp_matches(n.low, '\ba&m\b|\bam\b') and not regexp_matches(t.low, 'a-m|a&m|am')))
  select name, team_id, {st('score')} as score from s where score >= 0.6 - 1e-9""")
def similar_teams(spark, d):
    """Names of a provider and the teams of a catalogue that are like them: States, Techs and A&Ms keep apart."""
    table(spark, d, "part").createOrReplaceTempView("catalogue_part")
    teams, names = (spark.sql(x.replace("from part", "from catalogue_part")) for x in (_TEAMS, _NAMES))
    return rounded(catalogue.similar(names, teams, 0.6), "score")
