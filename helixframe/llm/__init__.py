"""Training-data operators: language id, packing, deduplication, scoring, formats.

Nothing else in the package imports this subpackage.
"""
