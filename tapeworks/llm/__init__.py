"""Training-data operators: tokenising, deduplication, quality, extraction, scoring.

Nothing outside this package imports it.  ``queries`` holds the thin contract
queries; the operators themselves keep general interfaces.
"""
