"""Operators for preparing training data at corpus scale.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded import of
``__spark_entry__.py``) imports it. Every operator selects only the columns it is told to use, so
extra columns, and columns whose names clash with an output, never reach a result unless the
operator says that it returns the input's columns.
"""
