"""Operators for preparing text corpora (training-data pipelines).

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries and their SQL for the driver contract.
"""
