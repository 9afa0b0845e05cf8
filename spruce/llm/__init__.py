"""Operators of a large training-data pipeline (see the module docstrings).

Nothing else in the library imports this subpackage.
"""
