"""Operators for preparing large text corpora for training.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
