"""tillcast: retail demand and inventory analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small tuple
of DataFrames) built from Spark SQL expressions, window functions, higher-order
array functions and MLlib trees.  Nothing in the core runs a Python UDF.
"""

from tillcast.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
