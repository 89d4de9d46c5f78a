"""Pick cards of spreads and totals by example."""

from pyspark.sql import functions as F

from rookery.functions import frames

# handicaps of the home side of model and market, and the card that is wanted
SPREADS = [
    (-3.5, -6.5, ("Away", 6.5, "Away +6.5", 3.0, 3.5, False)),  # the underdog has value
    (-10.0, -6.5, ("Home", -6.5, "Home -6.5", 3.5, -10.0, False)),  # the favourite has
    (3.0, -2.0, ("Away", 2.0, "Away +2.0", 5.0, 3.0, True)),  # favourites disagree
    (-7.0, -7.2, ("Home", -7.0, "Home -7.0", 0.0, None, False)),  # equal to the half point
    (0.0, 0.0, ("Away", 0.0, "Away 0.0", 0.0, None, False)),
    (-0.2, -6.0, ("Away", 6.0, "Away +6.0", 6.0, 0.0, False)),
    (-1.0, -0.5, ("Home", -0.5, "Home -0.5", 0.5, -1.0, False)),
]
TOTALS = [(59.0, 55.5, ("Over", "Over 55.5", "Over by 3.5 (Model 59.0 vs Market 55.5)", 59.0)), (50.0, 55.3, ("Under", "Under 55.5", "Under by 5.3 (Model 50.0 vs Market 55.3)", 50.0)), (55.0, 55.0, (None, None, None, None)), (55.05, 55.0, ("Over", "Over 55.0", None, None)), (None, 55.0, (None, None, None, None))]


def test_spread_cards(spark):
    df = spark.createDataFrame([(i, m, k) for i, (m, k, _) in enumerate(SPREADS)], "i int, m double, k double")
    card = frames.spread_card("m", "k", frames.value_over_market("m", "k"), F.lit("Home"), F.lit("Away"))
    for r in df.select("i", card.alias("c")).collect():
        assert tuple(r.c) == SPREADS[r.i][2], SPREADS[r.i]


def test_total_cards(spark):
    df = spark.createDataFrame([(i, m, k) for i, (m, k, _) in enumerate(TOTALS)], "i int, m double, k double")
    for r in df.select("i", frames.total_card("m", "k").alias("c")).collect():
        want = TOTALS[r.i][2]
        assert (r.c.pick, r.c.label, r.c.bet_to) == (want[0], want[1], want[3])
        assert want[2] is None or r.c.edge_text == want[2]
