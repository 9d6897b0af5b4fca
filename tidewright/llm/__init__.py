"""Operators for preparing training data at corpus scale.

Nothing else in the package imports this subpackage; see ``queries`` for the
registered queries.
"""
