"""Registered queries: each module has ``queries()`` (name -> function of session and folder) and ``oracle_sql()``."""
