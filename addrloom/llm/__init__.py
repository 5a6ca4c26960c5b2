"""Corpus preparation operators for large training sets.

Ten operators over ``documents``, ``pages`` and ``embeddings`` tables; nothing
else in the package imports this subpackage.
"""
