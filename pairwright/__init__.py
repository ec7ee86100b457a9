"""Quality measurement of large résumé and job pair tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that they need no copy of it on their disks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
