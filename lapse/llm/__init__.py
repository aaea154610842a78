"""Operators of a training-data pipeline over ``documents`` and ``conversations``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
``queries`` holds the registered ``opN_<name>`` queries and their SQL.
"""
