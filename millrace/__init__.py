"""Document retrieval, analytics and training data on Spark.

Every function and object that tasks use is shipped by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
