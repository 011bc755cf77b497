"""Training-data operators: deduplication, scans, sharding, mixing, tokenising.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin ``opN_*`` queries and their SQL.
"""
