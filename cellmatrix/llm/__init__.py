"""Training-data operators: archives, deduplication, filtering, scoring, mixing.

Nothing outside this subpackage imports it.
"""
