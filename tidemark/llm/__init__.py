"""Operators that prepare text for training: ten of them, one module each.

Nothing else in the library imports this subpackage.
"""
