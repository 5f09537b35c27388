"""Operators of a training-data pipeline over a `documents` table.

Nothing outside this package imports it.  `registry` names the queries.
"""
