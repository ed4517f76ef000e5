"""Training-data operators: tokens, near duplicates, packing, filters, scans and archives.

Nothing outside this package imports it; it can be deleted as a whole.
"""
