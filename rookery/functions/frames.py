"""Sign frames of spreads, named in every column: _hma, _fc and _book.

HMA is home minus away, positive where home is favoured. FC is favourite-centric and never positive. Book
is one team's handicap; the row says whose. One function converts each pair of frames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions.numbers import Number, col, round_to_half


def book_to_hma(handicap: Number, is_home: Column) -> Column:
    return F.when(is_home, -col(handicap)).otherwise(col(handicap))


def hma_to_fc(spread_hma: Number) -> Column:
    return -F.abs(col(spread_hma))


def favourite(spread_hma: Number) -> Column:
    """Taken from the HMA sign, never from a favourite-centric value; null at a pick'em."""
    return F.when(col(spread_hma) > 0, "home").when(col(spread_hma) < 0, "away")


def bettable(model_hma: Number, market_hma: Number, floor: float = 0.1) -> Column:
    """Side, line and edge of the pick against a market spread, null under the edge floor."""
    edge = col(model_hma) - col(market_hma)
    side = F.when(edge > 0, "home").otherwise("away")
    return F.when(F.abs(edge) >= floor, F.struct(side.alias("side"), F.when(edge > 0, -col(market_hma)).otherwise(col(market_hma)).alias("line_book"), edge.alias("edge")))


def total_pick(model: Number, market: Number, floor: float = 2.5) -> Column:
    edge = col(model) - col(market)
    return F.when(edge >= floor, "over").when(edge <= -floor, "under")


def label(team: Column, line: Number) -> Column:
    """``Team -4.5`` or ``Team +4.5``, to the half point."""
    line = round_to_half(line)
    return F.concat(team, F.lit(" "), F.when(line >= 0, "+").otherwise(""), F.format_string("%.1f", line))


def consistent(home_score: Number, away_score: Number, total: Number, spread_hma: Number) -> Column:
    """Implied scores that agree with total and spread to half a point."""
    return (F.abs(col(home_score) + col(away_score) - col(total)) <= 0.5) & (F.abs(col(home_score) - col(away_score) - col(spread_hma)) <= 0.5)


def laid(handicap: Number) -> tuple[Column, Column]:
    """Of the home side's handicap (negative where home is favoured) whether home is the favourite, at 0 it is not, and the favourite's line to the half point."""
    return col(handicap) < 0, 0.0 - round_to_half(F.abs(col(handicap)))


def value_over_market(model: Number, market: Number) -> Column:
    """Edge between two handicaps of the home side: the favourite's line of the model less that of the market, or, where they favour different sides, model less market."""
    (m_home, m_line), (k_home, k_line) = laid(model), laid(market)
    return F.when(m_home == k_home, m_line - k_line).otherwise(col(model) - col(market))


def spread_card(model: Number, market: Number, edge: Number, home: Column, away: Column, floor: float = 0.1) -> Column:
    """The pick against a market spread, both as the home side's handicaps: team, line, label, edge_pts, bet_to, disagree.

    Where the favourites disagree or the edge is over 0 it is the market's underdog, else, below 0, its favourite; an edge of 0 names the favourite without a line to bet to.
    """
    (m_home, m_line), (k_home, k_line) = laid(model), laid(market)
    disagree = m_home != k_home
    dog = disagree | (col(edge) > 0)
    favourite, underdog = F.when(k_home, home).otherwise(away), F.when(k_home, away).otherwise(home)
    line = F.when(dog, -k_line).otherwise(k_line) + 0.0
    to = F.when(dog, F.greatest(F.lit(0.0), F.abs(round_to_half(m_line - floor)))).when(col(edge) < 0, F.least(F.lit(-0.5), round_to_half(m_line + floor)))
    team = F.when(dog, underdog).otherwise(favourite)
    text = F.concat(team, F.when(dog, F.lit(" +")).otherwise(F.lit(" ")), F.format_string("%.1f", line))
    return F.struct(team.alias("team"), line.alias("line"), text.alias("label"), F.abs(col(edge)).alias("edge_pts"), to.alias("bet_to"), disagree.alias("disagree"))


def total_card(model: Number, market: Number, floor: float = 0.1) -> Column:
    """Pick, label, edge text and ``bet_to`` of a total: the side of the model wherever it differs from the market, and the total at which ``floor`` of the edge is left (null if it is less now)."""
    edge = col(model) - col(market)
    side = F.when(edge > 0, "Over").when(edge < 0, "Under")
    shown = lambda x: F.format_string("%.1f", x)
    text = F.concat(side, F.lit(" by "), shown(F.abs(edge)), F.lit(" (Model "), shown(col(model)), F.lit(" vs Market "), shown(col(market)), F.lit(")"))
    to = F.when(F.abs(edge) >= floor, F.when(edge > 0, round_to_half(col(model) - floor)).otherwise(round_to_half(col(model) + floor)))
    return F.struct(side.alias("pick"), F.concat(side, F.lit(" "), shown(round_to_half(market))).alias("label"), text.alias("edge_text"), to.alias("bet_to"))
