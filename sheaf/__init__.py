"""sheaf: web-collection data work (tasks, logs, pages, results) as Spark jobs.

The package is registered for pickling by value, so the small functions that run
in Python workers need no copy of it on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
