"""Whole pipelines, composed of the operators."""
