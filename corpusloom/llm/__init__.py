"""Training-data operators for large text corpora.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
