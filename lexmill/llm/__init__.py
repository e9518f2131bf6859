"""Operators for training-data pipelines, each built by one named method."""
