"""A PySpark-native engine for building and querying semantic networks out of web pages."""

import sys

from pyspark import cloudpickle

# functions that run in executors' Python workers travel with the plan, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
