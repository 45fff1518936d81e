"""lexiloom: text and speech corpus preparation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers receive our functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
