"""Operators for preparing training text at scale.

Nothing outside this folder imports it; ``queries.py`` lists the queries it adds.
"""
