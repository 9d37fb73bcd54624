"""Where tables, ontologies and queries come from."""
