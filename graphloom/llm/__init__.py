"""Training-data operators: text fingerprints, filters, de-duplication and packing.

Nothing outside this subpackage imports it.
"""
