"""Operators for training-data pipelines over tables of documents and pages.

Nothing outside this package imports it. Functions that run in Python workers
travel with the task: each module registers itself to be shipped by value.
"""
