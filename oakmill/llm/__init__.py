"""Training-data operators: ten operators over corpora, their queries and SQL.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
