"""Corpus operators for training-data pipelines, as Spark jobs.

Nothing outside this subpackage imports it.
"""
