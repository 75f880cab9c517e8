"""The labeling projection on an unbounded table."""
