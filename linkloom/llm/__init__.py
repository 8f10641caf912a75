"""Training-data operators: language ID, deduplication, tokenisation, scans, mixing and media features.

Nothing outside this subpackage imports it; the package works without the folder.
"""
