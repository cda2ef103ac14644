"""Training-data operators: archives, packing, private data, deduplication, search, counts.

Every function that runs on executors is shipped by value, so the workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
