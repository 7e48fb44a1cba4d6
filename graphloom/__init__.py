"""Vertex-centric graph analytics as Spark jobs."""
