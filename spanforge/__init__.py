"""Annotation tables at corpus scale: build, check and score text annotations with Spark."""
