"""Neighbour-dependent sequence analytics as Spark jobs."""
