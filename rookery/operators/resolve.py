"""Names to ids: exact, alias, slug, then token similarity, each tier a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import breaks_parity, guarded_team, jaccard, name_tokens, slug, without_parentheses
from rookery.operators.asof import cascade


def fuzzy(names: DataFrame, teams: DataFrame, least: float = 0.9, best: int = 3) -> DataFrame:
    """Candidates of each name by Jaccard similarity of tokens, through an equality join on tokens, so no pair without a shared token is formed. A candidate that breaks the parity of State, Tech or A&M is none."""
    n = names.select("name", name_tokens(F.col("name")).alias("tokens")).distinct()
    t = teams.select("team_id", "team", name_tokens(F.col("team")).alias("team_tokens"))
    met = n.withColumn("token", F.explode("tokens")).join(t.withColumn("token", F.explode("team_tokens")), "token").where(~breaks_parity(F.col("name"), F.col("team"))).select("name", "team_id", "tokens", "team_tokens").distinct()
    scored = met.withColumn("score", jaccard(F.col("tokens"), F.col("team_tokens"))).where(F.col("score") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "team_id")))
    return ranked.where(F.col("rank") <= best).select("name", "team_id", "score", "rank")


def resolved(names: DataFrame, teams: DataFrame, aliases: DataFrame, least: float = 0.9) -> DataFrame:
    """name, team_id and tier: exact name, alias, slug, slug without parentheses, then the one most similar team; a tie resolves to nothing."""
    n = names.select("name").distinct()
    exact = n.join(teams.select(F.col("team").alias("name"), "team_id"), "name")
    alias = n.join(aliases.select(F.col("alias").alias("name"), "team_id"), "name")
    t = teams.select(slug(F.col("team")).alias("slug"), "team_id")
    slugged = n.withColumn("slug", slug(F.col("name"))).join(t, "slug").groupBy("name").agg(F.min("team_id").alias("team_id"))
    bare = n.withColumn("slug", slug(without_parentheses(F.col("name")))).join(t, "slug").groupBy("name").agg(F.min("team_id").alias("team_id"))
    close = fuzzy(n, teams, least, best=2)
    top = close.groupBy("name").agg(F.max("score").alias("score"))
    sure = close.join(top, ["name", "score"]).groupBy("name").agg(F.count("*").alias("n"), F.min("team_id").alias("team_id")).where("n = 1")
    return cascade(n, [exact, alias, slugged, bare, sure], "name", "team_id")


def guarded(names: DataFrame, teams: DataFrame) -> DataFrame:
    """name and team_id of names under a guard, by the slug of the team."""
    g = names.select("name", guarded_team(F.col("name")).alias("slug")).where("slug is not null").distinct()
    return g.join(teams.select(slug(F.col("team")).alias("slug"), "team_id"), "slug").groupBy("name").agg(F.min("team_id").alias("team_id"))


def shared(aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """Team ids that both have."""
    return aliases.select("team_id").intersect(teams.select("team_id"))


def every_id(*sources: DataFrame) -> DataFrame:
    """The team ids of all sources, each once."""
    out = sources[0].select("team_id")
    for s in sources[1:]:
        out = out.union(s.select("team_id"))
    return out.distinct()


def missing(aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """Team ids that aliases name and teams lack."""
    return aliases.select("team_id").subtract(teams.select("team_id"))
