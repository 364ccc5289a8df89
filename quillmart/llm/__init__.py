"""Operators for preparing language-model training data, each a DataFrame job.

Nothing outside this subpackage imports it.
"""
