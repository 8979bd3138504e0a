"""Operators for training-data pipelines over tables of text.

Nothing else in the library imports this subpackage.  ``queries`` holds the registered queries and
``oracles`` their SQL; the operators themselves are one module each.
"""
