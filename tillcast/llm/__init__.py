"""Training-data operators: text statistics, deduplication, mixing, tokens, link trust.

Nothing else in the library imports this subpackage.
"""
