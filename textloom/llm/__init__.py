"""Training-data operators: language id, token counts, near-dedup, filters, scoring, search.

Nothing else in the library imports this subpackage.
"""
