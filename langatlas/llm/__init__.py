"""Operators of a large-scale training-data pipeline (documents and web pages).

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is present.
"""
