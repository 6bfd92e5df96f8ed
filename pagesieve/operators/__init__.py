"""DataFrame operators of the curation pipeline."""
