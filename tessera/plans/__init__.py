"""Session, lineage and plan helpers."""
