"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``; nothing else in the library imports them."""
