"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; ``revlens.llm.catalog``
lists its queries and their oracle SQL.
"""
