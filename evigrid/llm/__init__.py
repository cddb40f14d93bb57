"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage: it can be removed without touching the spatial engine.
"""
