"""Mappings, their materialisation, queries over them, and the pipeline that makes them."""
