"""Spark-native fare-transaction fraud analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from the public
PySpark DataFrame API; Catalyst and AQE choose the physical plan.
"""

__version__ = "0.1.0"
