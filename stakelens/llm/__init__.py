"""Training-data operators: filters, deduplication, archives, mixing and packing.

Nothing else in the library imports this subpackage.
"""
