"""Training-data operators. Nothing outside this subpackage imports it.

``queries.QUERIES`` and ``queries.ORACLE_SQL`` are what the entry module
registers.
"""
