"""Spark jobs for tag-vector retrieval: vectors, ranking, resolution, evaluation and catalog upkeep."""
