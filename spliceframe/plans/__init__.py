"""Plan helpers: cutting lineage in loops."""
