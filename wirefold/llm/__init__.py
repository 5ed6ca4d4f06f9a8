"""Operators for large training-data pipelines. Nothing outside this package,
``corpus_pipeline.py`` and ``__spark_entry__.py`` imports it."""
