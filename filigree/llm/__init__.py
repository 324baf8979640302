"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it; ``queries.py`` holds its thin
contract queries and ``oracles.py`` their SQL.
"""
