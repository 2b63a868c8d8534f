"""Training-data operators: formatting, packing, counting, scrubbing, language ID, search and deduplication.

Nothing outside this subpackage imports it; it may use the rest of the library.
"""
