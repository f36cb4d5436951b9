"""Training-data operators: quality rules, near-dedup, secrets, PII, mixing, sharding, tokens.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries, ``sql`` their DuckDB twins.
"""
