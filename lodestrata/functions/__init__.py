"""Scalar functions as Column expressions: names, identifiers, types, IRIs."""
