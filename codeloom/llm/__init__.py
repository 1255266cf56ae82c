"""Training-data operators: dedup, scans, classifiers, sharding, packing, search and mixing.

Nothing else in the library imports this subpackage.
"""
