"""Spark-first analytics for ratings, market lines, bets and training corpora."""
