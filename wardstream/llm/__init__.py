"""Training-data operators for very large text corpora.

Nothing outside this package imports it; the rest of the library works without it.
"""
