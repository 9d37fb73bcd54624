"""Relational tables to a queryable knowledge graph, as Spark DataFrame plans."""
