"""Provider names to teams of a catalogue of any size.

Names that no rule settles meet teams by an exact set-similarity join: tokens are put in order of how rare they are in the catalogue,
and two sets of Jaccard similarity t or more share one of their rarest tokens, size - ceil(t * size) + 1 of them each, and have sizes within t of each other. So a name meets
teams by its rare tokens, never by State, and every pair that meets is verified whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import breaks_parity, excepted, guarded_team, jaccard, provider_name, slug, without_mascot
from rookery.operators.asof import cascade


def _ordered(rows: DataFrame, id: str, x: str, frequencies: DataFrame, least: float) -> DataFrame:
    """id, x, ``size``, its tokens and its ``prefix``, the rarest tokens that a similar set must share one of."""
    words = F.filter(F.array_distinct(F.split(provider_name(F.col(x)), " ")), lambda w: w != "")
    each = rows.select(id, x, words.alias("tokens")).where(F.size("tokens") > 0).withColumn("token", F.explode("tokens"))
    ranked = each.join(frequencies, "token", "left").groupBy(id, x, "tokens").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("o"))  # the tokens of one name
    size = F.size("tokens")
    kept = (size - F.ceil(least * size - 1e-9) + 1).cast("int")
    return ranked.select(id, x, "tokens", size.alias("size"), F.slice(F.col("o.token"), 1, kept).alias("prefix"))


def similar(names: DataFrame, teams: DataFrame, least: float = 0.5) -> DataFrame:
    """name, team_id and score of all pairs of Jaccard similarity ``least`` or more that do not break the parity of State, Tech and A&M."""
    frequencies = teams.select(F.explode(F.array_distinct(F.split(provider_name(F.col("team")), " "))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    n = _ordered(names.select("name", F.col("name").alias("given")).distinct(), "name", "given", frequencies, least)
    t = _ordered(teams.select("team_id", "team").distinct(), "team_id", "team", frequencies, least)
    left = n.select("name", F.col("tokens").alias("a"), F.col("size").alias("m"), F.explode("prefix").alias("token"))
    right = t.select("team_id", "team", F.col("tokens").alias("b"), F.col("size").alias("k"), F.explode("prefix").alias("token"))
    near = (F.col("k") >= least * F.col("m") - 1e-9) & (F.col("m") >= least * F.col("k") - 1e-9)
    met = left.join(right, "token").where(near).drop("token").distinct()
    scored = met.withColumn("score", jaccard(F.col("a"), F.col("b"))).where((F.col("score") >= least - 1e-9) & ~breaks_parity(F.col("name"), F.col("team")))
    return scored.groupBy("name", "team_id").agg(F.max("score").alias("score"))  # a team may have several names


def candidates(names: DataFrame, teams: DataFrame, least: float = 0.5, best: int = 3) -> DataFrame:
    """The ``best`` similar teams of each name: name, team_id, score and rank; ties by team_id."""
    ranked = similar(names, teams, least).withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "team_id")))
    return ranked.where(F.col("rank") <= best)


#: What each tier of ``resolved`` is.
TIERS = ("id", "guard", "exception", "slug", "alias", "mascot", "last word", "name and mascot", "similar")


def resolved(names: DataFrame, teams: DataFrame, aliases: DataFrame, least: float = 0.9) -> DataFrame:
    """name, team_id and tier (a place in TIERS, null for neither): the first rule that settles a name. ``teams`` has team_id, team and mascot, ``aliases`` alias and team_id.

    Slugs, stripped mascots and similar names must keep the parity of State, Tech and A&M; guards, exceptions and aliases stand for themselves. Of teams of one slug
    the least team_id counts; two most similar teams settle nothing.
    """
    n = names.select("name").distinct().withColumn("_norm", provider_name(F.col("name")))
    by_slug = teams.select(slug(F.col("team")).alias("slug"), "team", "team_id")
    first = lambda df: df.where("slug is not null").join(by_slug, "slug")
    fair = lambda df: df.where(~breaks_parity(F.col("name"), F.col("team"))).groupBy("name").agg(F.min("team_id").alias("team_id"))
    plain = lambda df: df.groupBy("name").agg(F.min("team_id").alias("team_id"))
    ids = n.join(teams.select(F.col("team_id").cast("string").alias("name"), "team_id").distinct(), "name").select("name", "team_id")
    guard = plain(first(n.select("name", guarded_team(F.col("name")).alias("slug"))))
    exception = plain(first(n.select("name", excepted(F.col("name")).alias("slug"))))
    slugged = fair(first(n.select("name", slug(F.col("name")).alias("slug"))))
    alias = plain(n.join(aliases.select(provider_name(F.col("alias")).alias("_norm"), "team_id"), "_norm").select("name", "team_id"))
    mascot, word = (fair(first(n.select("name", slug(c).alias("slug")))) for c in without_mascot(F.col("_norm")))
    both = teams.select(slug(F.concat_ws(" ", "team", "mascot")).alias("slug"), "team", "team_id").where("mascot is not null")
    combined = fair(n.select("name", slug(F.col("name")).alias("slug")).join(both, "slug"))
    close = similar(n.select("name"), teams, least)
    top = close.groupBy("name").agg(F.max("score").alias("score"))
    sure = close.join(top, ["name", "score"]).groupBy("name").agg(F.count("*").alias("_n"), F.min("team_id").alias("team_id")).where("_n = 1")
    return cascade(n.select("name"), [ids, guard, exception, slugged, alias, mascot, word, combined, sure], "name", "team_id")
