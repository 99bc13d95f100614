"""Operators over DataFrames: latest rows, joins, votes, aggregates, statistics, ranking, sampling, similarity, quality."""
