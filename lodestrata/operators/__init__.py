"""Relational operators: profiles, dependencies, evidence, rankings, ontology closure, classification."""
