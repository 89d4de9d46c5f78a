"""Names to a catalogue: the similarity join against all pairs, and the order of the rules."""

import random
import re

from rookery.operators import catalogue

FILLER = r"\b(university|univ|college|the|football)\b"


def norm(x):
    return re.sub(r"\s+", " ", re.sub(FILLER, "", re.sub(r"[^a-z0-9\s-]", "", x.lower()))).strip()


def parity(name, team):
    n, t = name.lower(), team.lower()
    one = lambda w: bool(re.search(rf"\b{w}\b", n)) != (w in t)
    return one("state") or one("tech") or bool(re.search(r"\ba&m\b|\bam\b", n)) and not re.search("a-m|a&m|am", t)


def test_similar_pairs_match_all_pairs(spark):
    rng = random.Random(3)
    words = ["north", "south", "valley", "mount", "saint", "lake", "river", "pine", "state", "tech", "a&m", "the", "university", "of", "x", "y", "z"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
    teams = [(i, name()) for i in range(150)] + [(900, "the university"), (901, "")]
    names = [name() for _ in range(200)] + ["", "univ", "&"]
    t = spark.createDataFrame([(*x, None) for x in teams], "team_id int, team string, mascot string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    for least in (0.5, 0.9):
        want = {}
        for x in set(names):
            for i, y in teams:
                a, b = set(norm(x).split()), set(norm(y).split())
                if a and b and not parity(x, y) and len(a & b) / len(a | b) >= least - 1e-9:
                    want[x, i] = round(len(a & b) / len(a | b), 9)
        got = {(r.name, r.team_id): round(r.score, 9) for r in catalogue.similar(n, t, least).collect()}
        assert got == want and want
    top = {}
    for (x, i), s in sorted(want.items(), key=lambda kv: (kv[0][0], -kv[1], kv[0][1])):
        top.setdefault(x, []).append(i)
    got = {}
    for r in sorted(catalogue.candidates(n, t, 0.9).collect(), key=lambda r: r.rank):
        got.setdefault(r.name, []).append(r.team_id)
    assert got == {x: v[:3] for x, v in top.items()}


def test_rules_settle_names_in_their_order(spark):
    teams = [("sam-houston", "Sam Houston", "Bearkats"), ("texas-am", "Texas A&M", "Aggies"), ("texas", "Texas", "Longhorns"), ("iowa", "Iowa", "Hawkeyes"), ("iowa-state", "Iowa State", "Cyclones"), ("alabama", "Alabama", "Crimson Tide"), ("nc", "North Carolina Chapel Hill Main", None), ("dup1", "Pine Lake Valley", None), ("dup2", "Lake Pine Valley", None)]
    aliases = [("Bama", "alabama"), ("ISU", "iowa-state")]
    want = {
        "iowa": ("iowa", "id"), "Sam Houston State Bearkats": ("sam-houston", "exception"), "Iowa State": ("iowa-state", "slug"), "The Bama": ("alabama", "alias"), "Alabama Crimson Tide": ("alabama", "mascot"), "Iowa Hawkeyes": ("iowa", "last word"),
        "Iowa State Cyclones": ("iowa-state", "last word"), "Iowa State Big Cyclones": (None, None), "Chapel Hill Main North Carolina": ("nc", "similar"), "Valley Pine Lake": (None, None), "Iowa Tech": (None, None), "Nobody": (None, None),
    }
    t = spark.createDataFrame(teams, "team_id string, team string, mascot string")
    a = spark.createDataFrame(aliases, "alias string, team_id string")
    n = spark.createDataFrame([(x,) for x in [*want, "Iowa State"]], "name string")
    got = {r.name: (r.team_id, None if r.tier is None else catalogue.TIERS[r.tier]) for r in catalogue.resolved(n, t, a).collect()}
    assert got == want
