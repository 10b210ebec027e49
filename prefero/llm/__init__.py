"""Training-data operators: mixing, URL filters, scoring, deduplication and scans.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own with a general interface; ``queries`` holds the thin
``opN_<name>`` queries and their SQL.
"""
