"""demandloom: retail demand analytics as Spark DataFrame operators.

Every operator is ``DataFrame -> DataFrame`` (or returns a small tuple of
DataFrames), so jobs are composed with ``df.transform(...)`` and planned by Catalyst.
"""
