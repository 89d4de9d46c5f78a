"""Scalar arithmetic as Columns: rounding, odds, stakes, tiers and adjustments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int | str


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x: Number, lo: Number, hi: Number) -> Column:
    return F.greatest(col(lo), F.least(col(hi), col(x)))


def round_up(x: Number, places: int = 0) -> Column:
    """Rounding whose ties go toward positive infinity: floor(x + 1/2) on the last place kept."""
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5) / scale


def round_to_half(x: Number) -> Column:
    return F.floor(col(x) * 2 + 0.5) / 2


def stable(x: Number, places: int = 4) -> Column:
    """Rounding for comparisons: a nudge keeps sums that differ in their last bit on one side of a tie."""
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5000001) / scale


def ratio(a: Number, b: Number) -> Column:
    """a / b, null where b is null or 0."""
    return F.when(col(b) != 0, col(a) / col(b))


def american_to_probability(price: Number) -> Column:
    """Implied probability of an American price; a price of 0 has none."""
    p = col(price)
    return F.when(p > 0, 100.0 / (p + 100.0)).when(p < 0, p / (p - 100.0))


def american_payout(price: Number) -> Column:
    """Profit per unit staked at an American price."""
    p = col(price)
    return F.when(p > 0, p / 100.0).when(p < 0, 100.0 / -p)


def fair_moneyline(probability: Number) -> Column:
    """The American price without margin of a probability strictly between 0 and 1."""
    p = col(probability)
    return F.when(p >= 0.5, round_up(-100.0 * p / (1 - p))).otherwise(round_up(100.0 * (1 - p) / p))


def win_probability(margin_hma: Number) -> Column:
    """Home win probability of a home-minus-away spread, kept within 1 and 99 per cent."""
    return clamp(1 / (1 + F.pow(F.lit(10.0), -col(margin_hma) / 14.5)), 0.01, 0.99)


def moneyline_value(probability: Number, price: Number) -> Column:
    """Percentage points by which a probability exceeds a price's implied one."""
    return (col(probability) - american_to_probability(price)) * 100


def moneyline_side(home_value: Number, away_value: Number) -> Column:
    """The side of more than one point of value; the larger wins, and home at a tie."""
    h, a = F.coalesce(col(home_value), F.lit(float("-inf"))), F.coalesce(col(away_value), F.lit(float("-inf")))
    return F.when((h > 1) & (h >= a), "home").when(a > 1, "away")


def moneyline_gate(spread: Number, market_spread: Number, value: Number) -> Column:
    """Why a moneyline is withheld, in order of precedence; null if it is not."""
    return (
        F.when(col(spread).isNull(), "no spread")
        .when(F.abs(col(spread)) > 24, "spread over 24")
        .when(F.abs(col(market_spread)) >= 21, "favourite of 21 or more")
        .when(col(value).isNull() | (col(value) <= 1), "no value")
    )


def blocked_underdog(market_spread: Number, edge: Number) -> Column:
    return (F.abs(col(market_spread)) >= 21) & (col(edge) > 0)


def kelly_stake(edge: Number, fraction: float) -> Column:
    """1 for fraction 0; else a tenth of the edge, at most 1/10, scaled and kept within 0.1 and 5."""
    return F.lit(1.0) if fraction == 0 else clamp(F.least(col(edge) / 100, F.lit(0.1)) * fraction * 10, 0.1, 5.0)


def bankroll_share(edge: Number, most: float) -> Column:
    return F.least(F.abs(col(edge)) / 10 * 0.25, F.lit(most))


def shrink(rating: Number, prior: Number, factor: Number) -> Column:
    return (1 - col(factor)) * col(rating) + col(factor) * col(prior)


def shrink_factor(confidence: Number, games: Number, base: float = 0.12, weight: float = 0.5) -> Column:
    """More shrinkage for low confidence (at most .15) and few games, within .18 and .42. A confidence that is null or 0 counts as .5, unknown games as none."""
    sure = F.when(col(confidence) != 0, col(confidence)).otherwise(0.5)
    n = F.coalesce(col(games), F.lit(0))
    few = F.when(n < 3, 0.18).when(n <= 4, 0.12).when(n <= 7, 0.06).otherwise(0.0)
    return clamp(base + F.least(F.lit(0.15), (1 - sure) * weight) + few, 0.18, 0.42)


def decay(weeks: Number, over: float = 8.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - col(weeks) / over)


def coverage(*columns: str) -> Column:
    """The share of the columns that are not null."""
    return sum(F.col(c).isNotNull().cast("double") for c in columns) / float(len(columns))


def tier(edge: Number, a: float = 4.0, b: float = 3.0, c: float = 2.0) -> Column:
    size = F.abs(col(edge))
    return F.when(size >= a, "A").when(size >= b, "B").when(size >= c, "C")


def degraded(grade: Column) -> Column:
    return F.when(grade == "A", "B").when(grade == "B", "C")


def conflict_bucket(conflict: Column, edge: Number) -> Column:
    """super_tier_a, tier_a and tier_b at edges of 4, 3 and 2 under a strong conflict; without a bet (null) tier_a from 3; else none."""
    size = F.abs(col(edge))
    strong = F.when(size >= 4, "super_tier_a").when(size >= 3, "tier_a").when(size >= 2, "tier_b")
    return F.when(conflict == "strong", strong).when(conflict.isNull(), F.when(size >= 3, "tier_a").when(size >= 2, "tier_b"))


def confidence(source: Column, *features: str) -> Column:
    """The share of the features that are known, times the quality of their source."""
    # Quality of a source.
    quality = F.when(source == "game", 1.0).when(source == "season", 0.9).when(source == "baseline", 0.7).otherwise(0.3)
    return coverage(*features) * quality


def zscore(x: Number, mean: Number, deviation: Number, null_as_zero: bool = False) -> Column:
    """Null stays null unless told otherwise; a deviation of 0 counts as 1."""
    z = (col(x) - col(mean)) / F.when(col(deviation) == 0, 1.0).otherwise(col(deviation))
    return F.coalesce(z, F.lit(0.0)) if null_as_zero else z


def overlay(model: Number, market: Number, strength: float = 0.25, cap: float = 3.0) -> Column:
    """The market moved toward the model, by at most ``cap``."""
    return clamp(strength * (col(model) - col(market)), -cap, cap)


def weather_penalty(wind: Number, precipitation: Number) -> Column:
    """Grade points: wind over 15 costs 0.05 a unit up to 3, a chance of rain over 50 costs 0.2."""
    blown = F.when(col(wind) > 15, F.greatest(F.lit(-3.0), -0.05 * (col(wind) - 15))).otherwise(0.0)
    return blown + F.when(col(precipitation) > 50, -0.2).otherwise(0.0)


def weather_line(wind: Number, precipitation: Column, temperature: Number) -> Column:
    """Points off a total: wind of 15 or more costs 1.5 and .1 a unit over it, and 3 at least; snow 2, other precipitation 1; below 20 degrees 1.5."""
    return (
        F.when(col(wind) >= 15, F.least(-1.5 - (col(wind) - 15) * 0.1, F.lit(-3.0))).otherwise(0.0)
        + F.when(precipitation == "snow", -2.0).when(precipitation != "none", -1.0).otherwise(0.0)
        + F.when(col(temperature) < 20, -1.5).otherwise(0.0)
    )


def weather_spread(wind: Number, home_style: Column, away_style: Column) -> Column:
    """Wind of 15 or more moves the spread by half a point against the side that passes where the other runs."""
    moved = F.when((home_style == "pass") & (away_style == "run"), 0.5).when((home_style == "run") & (away_style == "pass"), -0.5)
    return F.when(col(wind) >= 15, F.coalesce(moved, F.lit(0.0))).otherwise(0.0)


def injury_points(position: Column, severity: Column) -> Column:
    """Points lost to an injury by position and severity; other positions lose none."""
    # Points of a position, and the share of them a severity costs.
    points = F.create_map(*[F.lit(x) for x in ("QB", 2.5, "OL", 1.0, "DL", 1.0, "WR", 0.75, "RB", 0.75, "DB", 0.5)])
    return F.coalesce(points[position], F.lit(0.0)) * F.when(severity == "out", 1.0).when(severity == "questionable", 0.5).otherwise(0.25)


def injury_spread(position: Column, severity: Column, home: Column) -> Column:
    """What an injury adds to the home side's spread adjustment."""
    return F.when(home, -injury_points(position, severity)).otherwise(injury_points(position, severity))


def home_field(neutral: Column, base: Number, team: Number = 0.0, lo: float = 1.0, hi: float = 5.0) -> Column:
    return F.when(neutral, 0.0).otherwise(clamp(col(base) + F.coalesce(col(team), F.lit(0.0)), lo, hi))


def plays_per_game(pace: Number) -> Column:
    """A pace under 10 is minutes a play and becomes plays a game."""
    return F.when(col(pace) < 10, 60.0 / col(pace)).otherwise(col(pace))


def points_per_play(epa: Number, yards: Number) -> Column:
    """From expected points, else from yards a play, within .3 and .8; .5 where neither is known."""
    return F.coalesce(F.when(col(epa).isNotNull(), clamp(7 * col(epa), 0.3, 0.8)), F.when(col(yards).isNotNull(), clamp(0.14 * col(yards), 0.3, 0.8)), F.lit(0.5))


def commits_signal(five: Number, four: Number, three: Number, total: Number) -> Column:
    return ratio(5 * col(five) + 4 * col(four) + 3 * col(three), total)


def _share(x: Number) -> Column:
    """A share within 0 and 1; one over 1 is a percentage, a null is 0."""
    v = F.coalesce(col(x).cast("double"), F.lit(0.0))
    return clamp(F.when(v > 1, v / 100).otherwise(v), 0.0, 1.0)


def continuity(offense: Number, defense: Number, overall: Number, transfers_in: Number) -> Column:
    """0 to 1: returning production of both sides, each with .75 of the transfers in (at most .3), in equal halves. Null without any returning production."""
    attack = F.coalesce(col(offense), col(overall))
    a, b = _share(attack), _share(defense)
    fresh = 0.75 * F.least(F.lit(0.3), F.coalesce(col(transfers_in), F.lit(0)) / 20.0 * 0.3)
    side = lambda x, y: clamp(F.when(x > 0, x).otherwise(y) + fresh, 0.0, 1.0)
    return F.when(attack.isNotNull() | col(defense).isNotNull(), 0.5 * side(a, b) + 0.5 * side(b, a))


def positional_shock(passing: Number, rushing: Number, receiving: Number, defense: Number) -> Column:
    """0 to 1: what does not return, weighted .30, .25, .15 and .30 over what is known."""
    parts = [(passing, 0.30), (rushing, 0.25), (receiving, 0.15), (defense, 0.30)]
    top = sum(F.coalesce((1 - col(x)) * w, F.lit(0.0)) for x, w in parts)
    bottom = sum(F.when(col(x).isNotNull(), w).otherwise(0.0) for x, w in parts)
    return F.when(bottom > 0, clamp(top / bottom, 0.0, 1.0))


def mercenary_index(transfers_in: Number) -> Column:
    """0 to 1: transfers in, of 20."""
    return F.when(col(transfers_in).isNotNull(), clamp(col(transfers_in) / 20.0, 0.0, 1.0))


def portal_aggressor(net: Number) -> Column:
    """0 to 1: net transfers, from -5 to 10."""
    return F.when(col(net).isNotNull(), clamp((col(net) + 5) / 15.0, 0.0, 1.0))


def risk_points(continuity_score: Column, shock: Column, mercenary: Column, aggressor: Column) -> Column:
    """Risk of a rebuilt roster; an unknown index adds nothing."""
    two = lambda x: F.when(x > 0.67, 2).when(x > 0.33, 1).otherwise(0)
    return F.when(continuity_score < 0.5, 2).when(continuity_score < 0.7, 1).otherwise(0) + two(shock) + two(mercenary) + F.when(aggressor > 0.67, 1).otherwise(0)


def risk_band(continuity_score: Column, shock: Column, mercenary: Column, aggressor: Column) -> Column:
    points = risk_points(continuity_score, shock, mercenary, aggressor)
    return F.when(points >= 5, "high").when(points >= 3, "medium").otherwise("low")


def bet_to(fair: Number, floor: float = 0.1) -> tuple[Column, Column]:
    """How far a line is playable, and from where the other side is."""
    return col(fair) - floor, col(fair) + floor


def scoring_opportunity(start_yards: Number, gained: Number, end_yards: Number | None = None) -> Column:
    """A drive that reaches the 40: its end, else its start plus yards, at 60 or more. Unknown is none."""
    known = F.when(col(start_yards).isNotNull() & col(gained).isNotNull(), F.least(F.lit(100), clamp(start_yards, 0, 100) + col(gained)))
    end = known if end_yards is None else F.coalesce(F.when(col(end_yards).isNotNull(), clamp(end_yards, 0, 100)), known)
    return F.coalesce(end >= 60, F.lit(False))


def available_yards(start_yards: Number, gained: Number, end_yards: Number | None = None) -> Column:
    """The share of the field ahead that a drive gained, within 0 and 1; without yards by where it ended; null from the goal line."""
    start = F.when(col(start_yards).isNotNull(), clamp(start_yards, 0, 100))
    own = col(gained)
    if end_yards is not None:
        own = F.coalesce(own, F.when(col(end_yards).isNotNull(), clamp(end_yards, 0, 100) - start))
    return F.when((100 - start > 0) & own.isNotNull(), clamp(F.greatest(F.lit(0), own) / (100 - start), 0, 1))


#: Points of a conference.
CONFERENCES = {
    5.0: ("SEC", "Big Ten", "B1G"),
    2.0: ("ACC", "Big 12", "Pac-12", "Pac-10"),
    -2.0: ("American Athletic", "AAC", "Mountain West", "MWC", "Sun Belt"),
    -3.5: ("Mid-American", "MAC", "Conference USA", "C-USA", "C-USA (FCS)"),
    -5.0: ("Independent", "Unknown"),
    -6.0: ("Big Sky", "Big Sky (FCS)", "FCS"),
}


def conference_adjustment(conference: Column) -> Column:
    """Points of a team's conference; an unknown one costs 5."""
    out = F.lit(-5.0)
    for points, names in CONFERENCES.items():
        out = F.when(conference.isin(*names), points).otherwise(out)
    return out


def derived_rates(yards: str, passing_yards: str, attempts: str, rushing_yards: str, rushes: str, games: str) -> dict[str, Column]:
    """Yards a play, a pass and a rush, and plays a game; null where a part is unknown or 0."""
    known = lambda *names: sum(((F.coalesce(F.col(n), F.lit(0)) != 0).cast("int") for n in names), F.lit(0)) == len(names)
    plays = F.col(attempts) + F.col(rushes)
    return {
        "ypp": F.when(known(yards, attempts, rushes) & (plays > 0), F.col(yards) / plays),
        "ypa": F.when(known(passing_yards, attempts) & (F.col(attempts) > 0), F.col(passing_yards) / F.col(attempts)),
        "ypc": F.when(known(rushing_yards, rushes) & (F.col(rushes) > 0), F.col(rushing_yards) / F.col(rushes)),
        "pace": F.when(known(attempts, rushes, games) & (F.col(games) > 0), plays / F.col(games)),
    }


def provider_rates(row: dict[str, str]) -> dict[str, Column]:
    """Red-zone, penalty, pressure and havoc rates; ``row`` names the columns of trips, touchdowns, penalties, penalty_yards, sacks, hits, tfl, interceptions, fumbles and games. A missing number is 0."""
    v = {k: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for k, c in row.items()}
    per_game = lambda x: F.when(v["games"] > 0, x / v["games"])
    pressure = v["sacks"] + v["hits"]
    plays = v["sacks"] + v["tfl"] + v["interceptions"] + v["fumbles"]
    return {
        "red_zone_rate": F.when(v["trips"] > 0, v["touchdowns"] / v["trips"]).otherwise(0.0),
        "penalties_per_game": per_game(v["penalties"]),
        "penalty_yards_per_game": per_game(v["penalty_yards"]),
        "pressure_rate": F.when(pressure + v["tfl"] > 0, pressure / (pressure + v["tfl"])),
        "havoc_rate": F.when(plays > 0, plays / (plays + 100)),
    }


def matchup_class(home: Column, away: Column) -> Column:
    """Class of a pairing of tiers P5, G5 and FCS, whichever is at home; two FCS teams count as P5_P5."""
    pair = F.concat_ws("_", F.sort_array(F.array(home, away)))
    return F.when(pair == "G5_P5", "P5_G5").when(pair == "FCS_P5", "P5_FCS").when(pair == "FCS_G5", "G5_FCS").when(pair == "G5_G5", "G5_G5").otherwise("P5_P5")


def kept_quotes(value: Number, kind: Column) -> Column:
    """Sanity filters by kind of line; prices that leaked into spreads and totals go."""
    v = col(value)
    leak = (F.abs(v) >= 50) & (F.pmod(v, F.lit(5)) == 0)
    return F.when(kind == "spread", (F.abs(v) <= 50) & ~leak).when(kind == "total", v.between(20, 120) & ~(leak & (v > 100))).when(kind == "moneyline", (F.abs(v) >= 100) & (F.pmod(v, F.lit(5)) == 0)).otherwise(True)


def plausible_spread(value: Number) -> Column:
    return F.abs(col(value)) <= 50


def plausible_total(value: Number, result: bool = False) -> Column:
    return col(value).between(15, 120) if result else col(value).between(20, 90)
