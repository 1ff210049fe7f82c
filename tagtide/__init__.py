"""Social-stream analytics on PySpark.

Functions of this package travel to the executors by value, so only the driver needs it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
