"""Tessera: hybrid retrieval and research analytics as Spark jobs.

Python functions of this package travel to the executors by value, so that
nothing has to be installed there beside Spark's own requirements.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
