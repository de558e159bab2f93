"""Operators for training-data preparation at corpus scale.

Nothing else in the library imports this subpackage.
"""
