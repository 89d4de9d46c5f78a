"""Queries on quotes: as-of and interval joins, consensus, histories, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import nested, numbers, times
from rookery.operators import aggregates, asof, bets, consensus, dedup, windows
from rookery.plans.registry import kicks, query, quotes, rounded, st
from rookery.session import table

RECORD = ["win_rate", "hit_rate", "stake", "pnl", "roi", "avg_edge", "avg_clv"]


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Bets at kickoffs, graded against the closing quote and valued to the usual payout."""
    closed = asof.asof(kicks(spark, d), quotes(spark, d), "game", "kick", "ts", "line", "quote_id", "kick_id")
    result = bets.spread_result("price", "line", raw=True)
    week = F.floor(times.seconds_between(F.col("kick"), F.lit("2024-01-01 00:00:00").cast("timestamp")) / (7 * 86400)).cast("int")
    out = closed.withColumns({"week": week, "result": result, "stake": F.lit(100.0), "edge": F.abs(F.col("price") - F.col("line")), "clv": F.col("line") - F.col("price")})
    return out.withColumns({"pnl": bets.profit(F.col("result"), "stake"), "tier": numbers.tier("edge", 40, 20, 5)})


GRADED = """
asofs as (select k.*, q.line, row_number() over (partition by kick_id order by (q.ts <= k.kick) desc nulls last, q.ts desc nulls last, q.quote_id desc) as n from kicks k left join quotes q using (game)),
graded as (select kick_id, game, kick, price, line, cast(floor((epoch_us(kick) - epoch_us(timestamp '2024-01-01')) / 604800000000.0) as integer) as week,
  case when abs(price - line) < 0.5 then 'push' when price - line > 0 then 'win' when price - line < 0 then 'loss' end as result,
  abs(price - line) as edge, line - price as clv from asofs where n = 1),
valued as (select *, case result when 'win' then 90.9 when 'loss' then -100.0 when 'push' then 0.0 end as pnl,
  case when edge >= 40 then 'A' when edge >= 20 then 'B' when edge >= 5 then 'C' end as tier from graded)"""

AGGS = f"""count(*) as bets, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes,
  {st("count(*) filter (where result = 'win') / nullif(count(*) filter (where result in ('win', 'loss')), 0)")} as win_rate,
  {st("count(*) filter (where result = 'win') / nullif(count(result), 0)")} as hit_rate,
  {st("count(*) * 100.0")} as stake, {st("sum(coalesce(pnl, 0))")} as pnl, {st("sum(coalesce(pnl, 0)) / (count(*) * 100.0)")} as roi, {st("avg(edge)")} as avg_edge, {st("avg(clv)")} as avg_clv"""


@query(f"with {GRADED} select week, tier, {AGGS}, cast(grouping(week, tier) as bigint) as level from valued group by grouping sets ((week), (tier), ())")
def grade_record(spark, d):
    return rounded(aggregates.breakdowns(graded(spark, d), "week", "tier"), *RECORD).withColumn("level", F.col("level").cast("bigint"))


@query("with a as (select k.*, q.line, q.ts, row_number() over (partition by kick_id order by (q.ts <= k.kick) desc nulls last, q.ts desc nulls last, q.quote_id desc) as n from kicks k left join quotes q using (game)) select kick_id, game, kick, price, line, ts, coalesce(ts <= kick, false) as on_time from a where n = 1")
def asof_closing_fallback(spark, d):
    return asof.asof(kicks(spark, d), quotes(spark, d), "game", "kick", "ts", "line", "quote_id", "kick_id")


@query("select k.kick_id, arg_max(q.line, q.ts) filter (where q.ts <= k.kick) as line, max(q.ts) filter (where q.ts <= k.kick) as ts from kicks k left join quotes q using (game) group by 1")
def asof_snapshot_strict(spark, d):
    return asof.asof(kicks(spark, d), quotes(spark, d), "game", "kick", "ts", "line", "quote_id", "kick_id", fallback=False).select("kick_id", "line", "ts")


@query(f"with r as (select game, cast(day(ts) as integer) as day, {st('avg(line)')} as rating from quotes group by 1, 2), k as (select kick_id, game, cast(day(kick) as integer) as day from kicks ) select kick_id, k.game, k.day, arg_max(rating, r.day) filter (where r.day <= k.day) as rating from k left join r using (game) group by 1, 2, 3")
def asof_week_rating(spark, d):
    ratings = rounded(quotes(spark, d).groupBy("game", F.dayofmonth("ts").alias("rating_day")).agg(F.avg("line").alias("rating")), "rating")
    left = kicks(spark, d).select("kick_id", "game", F.dayofmonth("kick").alias("day"))
    return asof.asof_week(left, ratings, "game", "day", "rating_day", "rating")


@query("select kick_id, quote_id, book, line from kicks k join quotes q using (game) where q.ts >= k.kick - interval 600 minute and q.ts <= k.kick + interval 50 minute")
def window_quotes(spark, d):
    return asof.in_window(kicks(spark, d), quotes(spark, d), "game", "kick", "ts", 600, 50).select("kick_id", "quote_id", "book", "line")


@query(f"with p as (select k.kick_id, q.line, q.ts >= k.kick - interval 600 minute and q.ts <= k.kick + interval 50 minute as inside from kicks k join quotes q using (game)), f as (select *, max(inside::int) over (partition by kick_id) as any_inside from p) select kick_id, count(*) as n, {st('median(line)')} as line from f where inside or any_inside = 0 group by 1")
def window_or_all_quotes(spark, d):
    found = asof.window_or_all(kicks(spark, d), quotes(spark, d), "game", "kick", "ts", "kick_id", 600, 50)
    return rounded(found.groupBy("kick_id").agg(F.count("*").alias("n"), F.median("line").alias("line")), "line")


@query("with p as (select kick_id, game, quote_id, line, abs(epoch_us(ts) - epoch_us(kick)) as gap_us, row_number() over (partition by kick_id order by abs(epoch_us(ts) - epoch_us(kick)), quote_id) as n from kicks join quotes using (game)) select kick_id, quote_id, line, gap_us from p where n = 1")
def nearest_event(spark, d):
    return asof.nearest(kicks(spark, d), quotes(spark, d), "game", "kick", "ts", "kick_id", "quote_id").select("kick_id", "quote_id", "line", "gap_us")


@query("with k as (select kick_id, game, day(kick) as day from kicks ), s as (select game, day(ts) as day, min(quote_id) as q from quotes group by 1, 2), g as (select game, min(quote_id) as q from quotes group by 1) select kick_id, coalesce(s.q, g.q) as match, cast(case when s.q is not null then 0 when g.q is not null then 1 end as integer) as tier from k left join s using (game, day) left join g using (game)")
def cascade_lookup(spark, d):
    k, q = kicks(spark, d).select("kick_id", "game", F.dayofmonth("kick").alias("day")), quotes(spark, d).withColumn("day", F.dayofmonth("ts"))
    exact = k.join(q, ["game", "day"]).groupBy("kick_id").agg(F.min("quote_id").alias("match"))
    loose = k.join(q.drop("day"), "game").groupBy("kick_id").agg(F.min("quote_id").alias("match"))
    return asof.cascade(k.select("kick_id"), [exact, loose], "kick_id", "match")


@query("with c as (select k.kick_id, count(*) as n, min(q.quote_id) as match from kicks k join quotes q on q.game = k.game and q.book = 'click' and abs(date_diff('day', q.ts::date, k.kick::date)) <= 1 group by 1) select k.kick_id, c.match from kicks k left join c on c.kick_id = k.kick_id and c.n = 1")
def lone_candidate(spark, d):
    right = quotes(spark, d).where("book = 'click'").select("game", "ts", F.col("quote_id").alias("match"))
    return asof.lone_candidate(kicks(spark, d), right, ["game"], "kick", "ts", "kick_id", "match", 1).select("kick_id", "match")


SANE = "abs(line) <= 50 and not (abs(line) >= 50 and fmod(line, 5) = 0)"


@query(f"with f as (select *, row_number() over (partition by game, book order by ts, quote_id) as n from quotes where {SANE}), c as (select game, floor(median(floor(-abs(line) * 2 + 0.5) / 2) * 2 + 0.5) / 2 as consensus_fc, count(*) as n_books from f where n = 1 group by 1), r as (select game, count(*) as n_raw from quotes group by 1) select r.game, n_raw, consensus_fc, n_books from r left join c using (game)")
def consensus_median(spark, d):
    return consensus.spread_consensus(quotes(spark, d), ["game"])


@query(f"select game, {st('median(line)')} as consensus_total, count(*) as n_quotes from quotes where line between 20 and 120 and not (abs(line) >= 50 and fmod(line, 5) = 0 and line > 100) group by 1")
def consensus_total(spark, d):
    return rounded(consensus.total_consensus(quotes(spark, d), ["game"]), "consensus_total")


@query("with p as (select game, case when quote_id % 2 = 0 then 5 * floor(line) + 100 else -(5 * floor(line) + 100) end as line from quotes ) select game, floor(median(line) filter (where line < 0) / 5 + 0.5) * 5 as favourite_price, floor(median(line) filter (where line > 0) / 5 + 0.5) * 5 as underdog_price from p where abs(line) >= 100 and fmod(line, 5) = 0 group by 1")
def consensus_moneyline(spark, d):
    price = 5 * F.floor("line").cast("double") + 100
    q = quotes(spark, d).withColumn("line", F.when(F.col("quote_id") % 2 == 0, price).otherwise(-price))
    return consensus.moneyline_consensus(q, ["game"])


@query(f"with b as (select game, book, median(line) as line from quotes where abs(line) <= 60 group by 1, 2) select game, {st('median(line)')} as consensus, count(*) as n_books from b group by 1 having count(*) >= 2")
def consensus_two_level(spark, d):
    return rounded(consensus.two_level_median(quotes(spark, d), ["game"]), "consensus")


@query(f"with q as (select *, game * 30 + day(ts) as g from quotes ), b as (select g, book, arg_max(line, ts) as line from q group by 1, 2), s as (select g, median(line) as median, count(*) as n, min(line) as single from b group by 1) select g as game, {st('case when n >= 2 then median else single end')} as line, case when n >= 2 then 'consensus' else 'single' end as tier from s")
def consensus_tiered(spark, d):
    q = quotes(spark, d).withColumn("game", F.col("game") * 30 + F.dayofmonth("ts"))
    return rounded(consensus.tiered_consensus(q, ["game"]), "line")


SOURCED = "select *, case when quote_id % 3 = 0 then null else 'T' || (quote_id % 2) end as team_id, case quote_id % 4 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as source, line - 40 as handicap from quotes "


def sourced(spark, d):
    q = quotes(spark, d)
    team = F.when(F.col("quote_id") % 3 != 0, F.concat(F.lit("T"), (F.col("quote_id") % 2).cast("string")))
    source = F.when(F.col("quote_id") % 4 == 0, "alpha").when(F.col("quote_id") % 4 == 1, "beta").otherwise("gamma")
    return q.withColumns({"team_id": team, "source": source, "handicap": F.col("line") - 40})


@query(f"with s as ({SOURCED}), r as (select *, row_number() over (partition by game order by team_id is null, case when handicap < 0 then 0 else 1 end, case source when 'beta' then 1 when 'alpha' then 2 else 3 end, ts desc, quote_id) as n from s) select game, quote_id, source, team_id, {st('handicap')} as line from r where n = 1")
def best_line(spark, d):
    q = sourced(spark, d).drop("line").withColumnRenamed("handicap", "line")
    return rounded(consensus.best_line(q, ["game"], ["beta", "alpha"]), "line").select("game", "quote_id", "source", "team_id", "line")


@query(f"with s as (select *, case when quote_id % 5 < 3 then 'spread' when quote_id % 5 = 3 then 'total' else 'moneyline' end as kind from ({SOURCED})), g as (select game, source, book, max((kind = 'spread')::int) * 100 + max((kind = 'total')::int) * 10 + max((kind = 'moneyline')::int) as score, max((team_id is not null)::int) as with_team, max(ts) as latest, arg_max(line, ts) filter (where kind = 'spread') as spread from s group by 1, 2, 3), r as (select *, row_number() over (partition by game order by with_team desc, score desc, latest desc, source, book) as n from g) select game, source, book, score, spread from r where n = 1")
def best_quote_group(spark, d):
    fifth = F.col("quote_id") % 5
    q = sourced(spark, d).withColumns({"line_type": F.when(fifth < 3, "spread").when(fifth == 3, "total").otherwise("moneyline"), "closing_line": F.lit(None).cast("double")})
    return consensus.best_group(q, ["game"]).select("game", "source", "book", "score", "spread")


@query("with h as (select game, book, ts, line from quotes where quote_id % 2 = 0), a as (select game, book, ts, line from quotes where quote_id % 2 <> 0) select h.game, h.book, h.line as home_line, a.line as away_line, case when h.line < a.line then 'home' when h.line > a.line then 'away' end as favourite from h join a using (game, book) where abs(epoch_us(h.ts) - epoch_us(a.ts)) <= 7200000000")
def opposite_sides(spark, d):
    q = quotes(spark, d).withColumn("is_home", F.col("quote_id") % 2 == 0)
    return consensus.opposite_sides(q, ["game"], 7200).select("game", "book", "home_line", "away_line", "favourite")


@query("with r as (select game, book, line, row_number() over (partition by game, book order by ts, quote_id) as n from quotes ), c as (select game, book, arg_min(line, n) as f, arg_min(line, n) filter (where abs(line) <= 20) as s from r group by 1, 2) select game, book, case when abs(f) <= 20 then f else s end as line, not (abs(f) <= 20) and s is null as warning from c")
def replaced_spread(spark, d):
    return consensus.replaced_spread(quotes(spark, d), ["game", "book"], 20)


@query(f"with b as (select day(k.kick) as day, k.kick_id, count(distinct q.book) as books, max((q.ts <= k.kick)::int) as before from kicks k left join quotes q using (game) group by 1, 2) select cast(day as integer) as day, count(*) as games, {st('avg(coalesce(before, 0))')} as pre_kick, {st('median(books)')} as median_books from b group by 1")
def quote_coverage(spark, d):
    k = kicks(spark, d).withColumn("day", F.dayofmonth("kick"))
    return rounded(consensus.coverage(k, quotes(spark, d), "game", "kick", "day"), "pre_kick", "median_books")


@query(f"select game, book, arg_min(line, ts) as opening, arg_max(line, ts) as closing, {st('arg_max(line, ts) - arg_min(line, ts)')} as movement, min(line) as least, max(line) as most, {st('max(line) - min(line)')} as spread, count(line) as quotes from quotes group by 1, 2")
def line_history_stats(spark, d):
    return rounded(windows.line_history(quotes(spark, d), ["game", "book"], "ts", "quote_id", "line"), "movement", "spread")


@query("select game, book, list(line order by ts)[-1] as latest, cast(len(list(line)) as integer) as n, list(line order by ts)[1] as first from quotes group by 1, 2")
def quotes_as_arrays(spark, d):
    series = F.sort_array(F.collect_list(F.struct("ts", "line")))
    grouped = quotes(spark, d).groupBy("game", "book").agg(series.alias("s"))
    return grouped.select("game", "book", F.element_at("s", -1)["line"].alias("latest"), F.size("s").alias("n"), F.element_at("s", 1)["line"].alias("first"))


@query("with r as (select *, row_number() over (partition by game, book order by ts desc, quote_id desc) as n from quotes ) select quote_id, game, book, ts, line from r where n = 1")
def latest_dedup(spark, d):
    return dedup.latest_per_key(quotes(spark, d), ["game", "book"], "ts", "quote_id")


@query("with r as (select *, row_number() over (partition by game, book order by ts, quote_id) as n from quotes ) select quote_id, game, book, ts, line from r where n = 1")
def first_per_book(spark, d):
    return dedup.first_per_key(quotes(spark, d), ["game", "book"], F.col("ts"), F.col("quote_id"))


SPLIT = "o as (select game, book, arg_max(line, ts) as line from quotes where day(ts) <= 15 group by 1, 2), n as (select game, book, arg_max(line, ts) as line from quotes where day(ts) > 15 group by 1, 2)"


def _halves(spark, d, last=15):
    """All quotes, cut by day of the month: the target, and from the day after ``last`` the changes."""
    q = quotes(spark, d)
    return [dedup.latest_per_key(q.where(c), ["game", "book"], "ts", "quote_id").select("game", "book", "line") for c in (f"day(ts) <= {last}", f"day(ts) > {last}")]


@query(f"with {SPLIT} select * from n union all select o.* from o left join n using (game, book) where n.line is null")
def upsert_quotes(spark, d):
    return dedup.upsert(*_halves(spark, d), ["game", "book"])


@query(f"with {SPLIT.replace('15', '1')} select n.* from n left join o using (game, book) where o.line is null")
def insert_ignore_quotes(spark, d):
    return dedup.insert_ignore(*_halves(spark, d, 1), ["game", "book"])


@query(f"with {SPLIT} select o.* from o where not exists (select 1 from n where n.game = o.game and n.book = o.book and n.line > 50)")
def cleanup_delete(spark, d):
    old, new = _halves(spark, d)
    return dedup.delete(old, new.where("line > 50").select("game", "book"), ["game", "book"])


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k from events where json_extract(props, '$.k') is not null")
def json_path(spark, d):
    k = nested.path(F.col("props"), "k int", "k")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k is not null")


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k, event_type as kind from events ")
def json_set_key(spark, d):
    merged = nested.with_key(F.col("props"), "kind", F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.from_json(merged, "k int, kind string").alias("p")).select("event_id", "p.k", "p.kind")


#: Each event's document, with keys that no schema declares: an object in an object, an array of mixed kinds, a null.
_OPEN = """'{"id":' || event_id || ',"zone":{"id":' || user_id || ',"tags":["' || event_type || '",2,null]},"note":null,"p":' || coalesce(props, '{}') || '}'"""


@query(f"""with o as (select event_id, event_type, value, cast({_OPEN} as json) as j from events ) select event_id, event_type as kind, cast(j->>'$.zone.id' as bigint) as zone, event_id as seen, j->>'$.zone.tags[0]' as tag, 2::bigint as second, cast(json_array_length(j, '$.zone.tags') as integer) as n_tags,
  cast(j->>'$.p.k' as integer) as k, case when value > 50 then 'high' end as note, json_type(j, '$.note') = 'NULL' and value <= 50 as note_is_null, 6 as n_keys from o""")
def json_open_keys(spark, d):
    """Keys set at the top and inside an object, a merge of two documents: all other keys stay, though none is declared."""
    e = table(spark, d, "events").withColumn("doc", F.expr(_OPEN))
    doc = nested.with_path(nested.opened(F.col("doc")), ("zone", "seen"), F.col("event_id"))
    doc = nested.with_path(doc, ("made", "here"), F.lit(True))
    patch = F.to_json(F.struct(F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "high").alias("note")))
    e = e.withColumn("doc", nested.merged(F.to_json(doc), patch)).withColumn("v", nested.opened(F.col("doc")))
    at = lambda path, kind="string": nested.found(F.col("v"), path, kind)
    return e.select(
        "event_id", at("$.kind").alias("kind"), at("$.zone.id", "bigint").alias("zone"), at("$.zone.seen", "bigint").alias("seen"), at("$.zone.tags[0]").alias("tag"), at("$.zone.tags[1]", "bigint").alias("second"), F.size(at("$.zone.tags", "array<variant>")).alias("n_tags"),
        at("$.p.k", "int").alias("k"), at("$.note").alias("note"), F.is_variant_null(at("$.note", "variant")).alias("note_is_null"), F.size(F.json_object_keys("doc")).alias("n_keys"),
    )


@query("with d as (select distinct ts::date as date from quotes ), r as (select date, dense_rank() over (order by date) as n from d) select q.quote_id, r.date from quotes q join r on r.date = q.ts::date where r.n <= 3")
def first_dates(spark, d):
    from pyspark.sql import Window

    q = quotes(spark, d).select("quote_id", F.to_date("ts").alias("date"))
    dates = q.select("date").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("date"))).where("n <= 3")  # a row to a date
    return q.join(F.broadcast(dates.select("date")), "date").select("quote_id", "date")


@query("with r as (select cast(weekofyear(ts) as integer) as week, min(ts) as first, max(ts) as last from quotes group by 1) select week, first, last from r order by case when first <= timestamp '2024-01-17' and last >= timestamp '2024-01-17' then 0 when first > timestamp '2024-01-17' then 1 else 2 end, first limit 1")
def current_week(spark, d):
    weeks = quotes(spark, d).groupBy(F.weekofyear("ts").alias("week")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return windows.current_week(weeks, F.lit("2024-01-17 00:00:00").cast("timestamp"))


@query(f"select quote_id, cast(floor((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 86400000000.0) as bigint) as days, {st('(epoch_us(timestamp ' + chr(39) + '2024-02-01' + chr(39) + ') - epoch_us(ts)) / 3600000000.0')} as hours, (ts - interval 6 hour)::date as local_date, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from quotes ")
def date_functions(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = quotes(spark, d).select("quote_id", times.whole_days(now, F.col("ts")).alias("days"), times.hours_since(F.col("ts"), now).alias("hours"), times.local_date(F.col("ts")).alias("local_date"), times.iso_seconds(F.col("ts")).alias("iso"))
    return rounded(out, "hours")


@query("select event_type as book, count(distinct user_id) as games, count(*) as quotes, max(ts) as latest from events group by 1")
def status_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("book")).agg(F.countDistinct("user_id").alias("games"), F.count("*").alias("quotes"), F.max("ts").alias("latest"))
