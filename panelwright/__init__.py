"""Point-in-time panels, backtests and training-data pipelines as Spark jobs."""
