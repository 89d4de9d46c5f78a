"""Power ratings, features and pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.numbers import clamp, conference_adjustment, decay, home_field, shrink, shrink_factor, tier
from rookery.operators import graphs
from rookery.operators.windows import standardised

NETS = ("epa", "sr", "explosive", "ppa", "havoc", "finish", "field")


def team_games(games: DataFrame) -> DataFrame:
    """Two rows to a game: team, opponent, points for and against, margin, is_home."""
    sides = F.array(
        F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.col("home_score").alias("pf"), F.col("away_score").alias("pa"), F.lit(True).alias("is_home")),
        F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.col("away_score").alias("pf"), F.col("home_score").alias("pa"), F.lit(False).alias("is_home")),
    )
    rest = [c for c in games.columns if c not in {"home", "away", "home_score", "away_score"}]
    return games.select(*rest, F.explode(sides).alias("s")).select(*rest, "s.*").withColumn("margin", F.col("pf") - F.col("pa"))


def records(games: DataFrame) -> DataFrame:
    """Wins, losses, points and mean margin of each team; a tie is neither."""
    t = team_games(games.where("home_score is not null and away_score is not null"))
    return t.groupBy("team").agg(
        F.count("*").alias("games"), F.count(F.when(F.col("margin") > 0, 1)).alias("wins"), F.count(F.when(F.col("margin") < 0, 1)).alias("losses"),
        F.sum("pf").alias("pf"), F.sum("pa").alias("pa"), F.avg("margin").alias("mean_margin"),
    )


def members_only(games: DataFrame, members: DataFrame) -> DataFrame:
    """Games of which both teams are members."""
    m = members.select("team").distinct()
    return games.join(m.withColumnRenamed("team", "home"), "home", "left_semi").join(m.withColumnRenamed("team", "away"), "away", "left_semi")


def adjusted_nets(rows: DataFrame, key: str = "game") -> DataFrame:
    """Opponent-adjusted nets of each metric: offence less the opponent's defence, defence turned round, edge their difference."""
    other = rows.select(key, F.col("team").alias("opponent"), *[F.col(f"{s}_{m}").alias(f"opp_{s}_{m}") for m in NETS for s in ("off", "def")])
    both = rows.join(other, [key, "opponent"], "left")
    nets = {}
    for m in NETS:
        off, deff = F.col(f"off_{m}") - F.col(f"opp_def_{m}"), -(F.col(f"def_{m}") + F.col(f"opp_off_{m}"))
        nets |= {f"off_adj_{m}": off, f"def_adj_{m}": deff, f"edge_{m}": off - deff}
    return both.withColumns(nets).drop(*other.columns[2:])


def index_rating(stats: DataFrame, weights: dict[str, float], keys: list[str], talent: str | None = None, week: str | None = None, scale: float = 8.0) -> DataFrame:
    """Weighted sum of z-scores (a null is 0), negative weights for defence, plus talent that decays over the season's first weeks."""
    z = standardised(stats, keys, *weights, *([talent] if talent else []), null_as_zero=True)
    total = sum(F.col(f"z_{c}") * w for c, w in weights.items())
    if talent:
        total = total + F.col(f"z_{talent}") * (decay(week) if week else F.lit(1.0))
    return z.withColumn("rating", total * scale)


# What each feature weighs in the first rating.
V1_OFFENSE = {"ypp_off": 0.30, "pass_ypa_off": 0.20, "rush_ypc_off": 0.15, "success_off": 0.20, "epa_off": 0.15}
V1_DEFENSE = {"ypp_def": 0.20, "pass_ypa_def": 0.20, "rush_ypc_def": 0.15, "success_def": 0.25, "epa_def": 0.20}
V1_TALENT = {"talent": 1.0, "blue_chips": 0.3, "commits": 0.15 * 0.15}


def v1_rating(stats: DataFrame, keys: list[str], scale: float = 8.0, by_conference: bool = True) -> DataFrame:
    """``offense``, ``defense`` and ``rating`` of teams: weighted z-scores (a null is 0), defence turned round, talent that fades over the weeks played, and the conference's points, times ``scale``.

    A team without any defensive yardage is weighed by success and expected points alone; one without yards a play and success on both sides by its talent alone.
    ``stats`` has the columns of V1_OFFENSE, V1_DEFENSE and V1_TALENT, ``weeks`` and ``conference``.
    """
    z = standardised(stats, keys, *V1_OFFENSE, *V1_DEFENSE, *V1_TALENT, null_as_zero=True)
    total = lambda weights: sum(F.col(f"z_{c}") * w for c, w in weights.items())
    some = lambda *names: F.coalesce(*names).isNotNull()
    least = {c: V1_DEFENSE[c] / (V1_DEFENSE["success_def"] + V1_DEFENSE["epa_def"]) for c in ("success_def", "epa_def")}
    defense = -F.when(some("ypp_def", "pass_ypa_def", "rush_ypc_def"), total(V1_DEFENSE)).otherwise(total(least))
    out = z.withColumns({"offense": total(V1_OFFENSE), "defense": defense})
    base = F.when(some("ypp_off", "ypp_def", "success_off", "success_def"), F.col("offense") + F.col("defense")).otherwise(0.0)
    points = conference_adjustment(F.col("conference")) if by_conference else F.lit(0.0)
    return out.withColumn("rating", (base + decay(F.coalesce("weeks", F.lit(0))) * total(V1_TALENT) + points) * scale)


def v4_rating(stats: DataFrame, keys: list[str], already_inverted: bool = False) -> DataFrame:
    """Half success, a quarter explosiveness, .15 finishing and .1 available yards, as z-scores of both sides; net, centred, times 10.

    Defence is better when low; ``already_inverted`` keeps the variant that turns it round twice.
    """
    parts = {"success": 0.5, "explosive": 0.25, "finish": 0.15, "available": 0.1}
    z = standardised(stats, keys, *[f"{s}_{p}" for s in ("off", "def") for p in parts], null_as_zero=True)
    off = sum(F.col(f"z_off_{p}") * w for p, w in parts.items())
    deff = sum(-F.col(f"z_def_{p}") * w for p, w in parts.items())
    net = z.withColumn("net", off - deff if already_inverted else off + deff)
    means = net.groupBy(*keys).agg(F.avg("net").alias("_mean"))
    joined = net.join(means, keys) if keys else net.crossJoin(F.broadcast(means))
    return joined.withColumn("rating", (F.col("net") - F.col("_mean")) * 10).drop("_mean")


def balanced_rating(stats: DataFrame, keys: list[str], columns: tuple[str, ...], scale: float = 14.0) -> DataFrame:
    z = standardised(stats, keys, *columns, null_as_zero=True)
    return z.withColumn("rating", sum(F.col(f"z_{c}") for c in columns) / float(len(columns)) * scale)


def unit_grades(stats: DataFrame, keys: list[str], blends: dict[str, dict[str, float]]) -> DataFrame:
    """Grades as z-score blends over what is known; a grade without anything known is null."""
    columns = sorted({c for b in blends.values() for c in b})
    z = standardised(stats, keys, *columns)
    grades = {}
    for name, blend in blends.items():
        top = sum(F.coalesce(F.col(f"z_{c}") * w, F.lit(0.0)) for c, w in blend.items())
        bottom = sum(F.when(F.col(f"z_{c}").isNotNull(), abs(w)).otherwise(0.0) for c, w in blend.items())
        grades[name] = F.when(bottom > 0, top / bottom)
    return z.withColumns(grades)


# The two figures of each unit's grade and which way they count.
SEVEN = {
    "off_run": (("line_yards_off", 1), ("rush_ppa_off", 1)), "def_run": (("stuff_rate", 1), ("rush_ppa_def", -1)), "off_pass": (("pass_ppa_off", 1), ("pass_sr_off", 1)), "def_pass": (("pass_ppa_def", -1), ("pass_sr_def", -1)),
    "off_explosiveness": (("iso_ppp_off", 1),), "def_explosiveness": (("iso_ppp_def", -1),), "havoc": (("havoc_def", 1), ("havoc_off", -1)),
}


def unit_inputs(members: DataFrame, games: DataFrame, ppa: DataFrame, season: DataFrame) -> DataFrame:
    """The figures of SEVEN of each member (team, season): means over its games (line_yards_off, iso_ppp_off, iso_ppp_def, pass_sr, def_sr, run_epa, pass_epa) with the mean
    points added of its games (ppa_off, ppa_def) where there are no runs' or passes' and for the defence, and its season's stuff rate and havoc. A table without a member's rows leaves nulls."""
    by = ["team", "season"]
    means = lambda df, **names: df.groupBy(*by).agg(*[F.avg(c).alias(n) for n, c in names.items()])
    own = means(games, line_yards_off="line_yards_off", iso_ppp_off="iso_ppp_off", iso_ppp_def="iso_ppp_def", pass_sr_off="pass_sr", pass_sr_def="def_sr", _run="run_epa", _pass="pass_epa")
    added = means(ppa, _off="ppa_off", _def="ppa_def")
    both = members.select(*by).distinct().join(own, by, "left").join(added, by, "left").join(season.select(*by, "stuff_rate", "havoc_off", "havoc_def"), by, "left")
    filled = {"rush_ppa_off": F.coalesce("_run", "_off"), "pass_ppa_off": F.coalesce("_pass", "_off"), "rush_ppa_def": F.col("_def"), "pass_ppa_def": F.col("_def")}
    return both.withColumns(filled).drop("_run", "_pass", "_off", "_def")


def seven_grades(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """The seven unit grades: the mean of the z-scores that are known of a unit's figures, each the way it counts; 0 where none is known."""
    columns = [c for pair in SEVEN.values() for c, _ in pair]
    z = standardised(inputs, keys, *columns)
    grades = {}
    for name, pair in SEVEN.items():
        terms = [F.col(f"z_{c}") * sign for c, sign in pair]
        known = sum(F.when(t.isNotNull(), 1).otherwise(0) for t in terms)
        grades[name] = F.when(known > 0, sum(F.coalesce(t, F.lit(0.0)) for t in terms) / known).otherwise(0.0)
    return z.withColumns(grades)


def strength_passes(ratings: DataFrame, games: DataFrame, passes: int = 3, tolerance: float = 0.01, weight: float = 0.25, prior: float = 0.0) -> DataFrame:
    """Up to ``passes`` corrections by the mean rating of opponents, stopped when no team moves by the tolerance, then shrinkage to a prior.

    Each pass is checkpointed, so the lineage does not grow and a lost executor costs one pass.
    """
    spark = ratings.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="rookery-")
        spark.sparkContext.setCheckpointDir(folder)
    pairs = team_games(games).select("team", "opponent")
    start = ratings.select("team", F.col("rating").alias("own"), F.col("rating").alias("now"), "confidence", "games").checkpoint()
    for _ in range(passes):
        faced = pairs.join(start.select(F.col("team").alias("opponent"), F.col("now").alias("theirs")), "opponent").groupBy("team").agg(F.avg("theirs").alias("faced"))
        moved = start.join(faced, "team", "left").withColumn("next", F.col("own") + weight * F.coalesce("faced", F.lit(0.0))).checkpoint()
        far = moved.agg(F.max(F.abs(F.col("next") - F.col("now")))).first()[0]
        start = moved.select("team", "own", F.col("next").alias("now"), "confidence", "games")
        if far is None or far < tolerance:
            break
    return start.select("team", F.col("now").alias("adjusted"), shrink("now", F.lit(prior), shrink_factor("confidence", "games")).alias("rating"))


def massey(games: DataFrame, ridge: float = 1e-6, prior: dict | None = None, weight: str | None = None) -> DataFrame:
    """Ratings whose differences fit margins: (A + ridge) x = b + ridge * prior, centred. Solved over tables, so any number of teams will do."""
    links = graphs.edges(games, (F.col("home_score") - F.col("away_score")).cast("double"), F.col(weight) if weight else None)
    teams = graphs.nodes(links)
    if prior:
        known = F.create_map(*[F.lit(x) for pair in prior.items() for x in pair])
        teams = teams.withColumn("b", F.col("b") + ridge * F.coalesce(F.element_at(known, F.col("team")).cast("double"), F.lit(0.0)))
    return graphs.centred(graphs.solve(links, teams, ridge, "b", scaled=False), F.col("x_b"))


def team_hfa(residuals: DataFrame, prior_games: float = 8.0) -> DataFrame:
    """Home-field advantage of each team: mean residual at home, shrunk to the league's median (within 1 and 4, outliers of 20 left out), within .5 and 5. Weight of few games is at most .4."""
    sane = residuals.where(F.abs("residual") <= 20)
    teams = sane.groupBy("team").agg(F.avg("residual").alias("raw"), F.count("*").alias("n"))
    league = teams.agg(clamp(F.median("raw"), 1.0, 4.0).alias("league"))
    weight = F.col("n") / (F.col("n") + prior_games)
    weight = F.when(F.col("n") < 4, F.least(weight, F.lit(0.4))).otherwise(weight)
    return teams.crossJoin(F.broadcast(league)).withColumn("hfa", clamp(weight * F.col("raw") + (1 - weight) * F.col("league"), 0.5, 5.0))


def training_pairs(rows: DataFrame, columns: tuple[str, ...], key: str = "game") -> DataFrame:
    """Home minus away of each column, by conditional aggregation over the two rows of a game; games with one row go."""
    side = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    pairs = rows.groupBy(key).agg(F.count("*").alias("_n"), *[(side(c, True) - side(c, False)).alias(f"diff_{c}") for c in columns])
    return pairs.where("_n = 2").drop("_n")


def matchups(games: DataFrame, ratings: DataFrame, base_hfa: float = 2.0, base_total: float = 45.0) -> DataFrame:
    """Implied spread and total of games from both teams' ratings."""
    home, away = (ratings.select(F.col("team").alias(s), F.col("rating").alias(f"{s}_rating")) for s in ("home", "away"))
    both = games.join(home, "home").join(away, "away")
    spread = F.col("home_rating") - F.col("away_rating") + home_field(F.coalesce("neutral", F.lit(False)), base_hfa)
    total = base_total + 0.5 * F.abs(F.col("home_rating") - F.col("away_rating"))
    return both.withColumns({"implied_hma": spread, "implied_total": total})


def with_edges(matched: DataFrame, market_spread: str, market_total: str) -> DataFrame:
    """Edges against the market and their tiers; totals count by size, so unders are graded too."""
    edges = matched.withColumns({"spread_edge": F.col("implied_hma") - F.col(market_spread), "total_edge": F.col("implied_total") - F.col(market_total)})
    return edges.withColumns({"spread_tier": tier("spread_edge"), "total_tier": tier("total_edge"), "max_edge": F.greatest(F.abs("spread_edge"), F.abs("total_edge"))})


def unit_spread(matched: DataFrame, scale: float = 9.0, hfa: float = 2.5) -> DataFrame:
    """Spread of unit grades: .4 run, .4 pass, .2 explosiveness of each offence against the other's defence."""
    net = lambda us, them: sum(w * (F.col(f"{us}_off_{u}") - F.col(f"{them}_def_{u}")) for u, w in {"run": 0.4, "pass": 0.4, "explosive": 0.2}.items())
    return matched.withColumn("unit_hma", (net("home", "away") - net("away", "home")) * scale + F.when(F.col("neutral"), 0.0).otherwise(hfa))


def hybrid(core_hma: str, unit_hma: str, weight: float = 0.7):
    return weight * F.col(core_hma) + (1 - weight) * F.col(unit_hma)


def tiered_features(teams: DataFrame, recent: DataFrame, season: DataFrame, baseline: DataFrame, column: str) -> DataFrame:
    """A feature from recent games, else the season, else a baseline, with its source."""
    out = teams
    for name, df in (("game", recent), ("season", season), ("baseline", baseline)):
        out = out.join(df.select("team", F.col(column).alias(f"_{name}")), "team", "left")
    source = F.when(F.col("_game").isNotNull(), "game").when(F.col("_season").isNotNull(), "season").when(F.col("_baseline").isNotNull(), "baseline").otherwise("missing")
    return out.select("team", F.coalesce("_game", "_season", "_baseline").alias(column), source.alias("source"))


# The conferences whose low talent stands for a team without any.
G5 = ("American Athletic", "Conference USA", "Mid-American", "Mountain West", "Sun Belt")


def talent_gap(games: DataFrame, talent: DataFrame, teams: DataFrame, least: int = 10, flat: float = 0.1) -> DataFrame:
    """Home minus away talent (team, season, talent) of the game's season: ``gap``, ``gap_z`` and ``home_filled``, ``away_filled``.

    A missing value is the 10th percentile of the season's teams in G5 conferences (team, conference), kept within their 5th and 25th (nearest ranks, of ``least`` values or
    more; else it stays unknown). ``gap_z`` is the gap over the deviation of all the season's teams, 0 where that is less than ``flat``, null in a season without talent.
    """
    from rookery.operators.aggregates import nearest_rank

    known = talent.where(F.col("talent").isNotNull() & ~F.isnan("talent") & (F.abs("talent") != float("inf")))
    low = known.join(teams.where(F.col("conference").isin(*G5)).select("team").distinct(), "team", "left_semi")
    ranks = nearest_rank(low, ["season"], "talent", {"p5": 0.05, "p10": 0.1, "p25": 0.25}).join(low.groupBy("season").agg(F.count("*").alias("_n")), "season").where(F.col("_n") >= least)
    fill = ranks.select("season", F.least(F.greatest("p10", "p5"), "p25").alias("_fill"))
    spread = known.groupBy("season").agg(F.stddev_pop("talent").alias("_sd"))
    home, away = (known.select(F.col("team").alias(s), "season", F.col("talent").alias(f"{s}_talent")) for s in ("home", "away"))
    both = games.join(home, ["home", "season"], "left").join(away, ["away", "season"], "left").join(spread, "season", "left").join(fill, "season", "left")
    gap = F.coalesce("home_talent", "_fill") - F.coalesce("away_talent", "_fill")
    both = both.withColumns({"gap": gap, "home_filled": F.col("home_talent").isNull(), "away_filled": F.col("away_talent").isNull()})
    return both.withColumn("gap_z", F.when(F.col("_sd") < flat, 0.0).otherwise(F.col("gap") / F.col("_sd"))).drop("_sd", "_fill")
