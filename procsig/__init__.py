"""procsig — labelled multi-series sensor analytics as lazy Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, window functions, aggregations and ``pyspark.ml``; nothing is collected to
the driver except one-row model parameters that are proven small by construction.
"""

from procsig.spec import SeriesSpec

__all__ = ["SeriesSpec"]
__version__ = "0.1.0"
