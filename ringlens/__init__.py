"""Spark analytics for coordinated account abuse: features, graph, models, evidence, decisions."""
