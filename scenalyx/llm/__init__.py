"""Operators for training-data pipelines on text. Nothing outside this subpackage imports it."""
