"""Training-data operators: deduplication, scans, filters, sampling and archives.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin ``opN_*`` queries live in :mod:`queries`.
"""
