"""Operators on text, pages, conversations and vectors for training-data pipelines.

Nothing else in the package imports this folder.
"""
