"""glossa: sense-aware corpus analytics on Spark.

Every operator maps DataFrames to DataFrames lazily.  Functions that run in Python workers are shipped by value, so
executors need pyspark, pyarrow, pandas and numpy but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
