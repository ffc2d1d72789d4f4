"""Operators of a training-data pipeline, and their registered queries.

Nothing outside this subpackage imports it; ``queries.py`` holds the queries and
``oracles.py`` the SQL that ``__spark_entry__.py`` adds when the subpackage is there.
"""
