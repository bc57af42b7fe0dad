"""Training-data operators: licence scan, media columns, decontamination, packing and the like.

Nothing outside this subpackage imports it.  ``catalog`` holds the registered queries.
"""
