"""Operators for preparing training text, apart from the review engine.

Nothing else in the package imports this one.
"""
