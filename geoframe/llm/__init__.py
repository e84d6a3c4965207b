"""Training-data operators: mixing, filtering, tokenising, searching and deduplicating text corpora.

Nothing else in the library imports this subpackage.
"""
