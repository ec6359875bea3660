"""Training-data operators on text corpora and embeddings.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
