"""Evidence-graph analytics and corpus preparation on Spark.

Python functions of this package travel to executors by value, so that a
cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
