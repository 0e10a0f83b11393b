"""Retail sales analytics as Spark DataFrame functions.

Every report is ``report(df, **params) -> DataFrame`` over the enriched sales
table; see :mod:`tallygrove.plans.registry` for the list of names.
"""
