"""Training-data operators: sharding, scoring, cleaning, deduplication, tokenising.

Nothing else in the library imports this subpackage. Functions defined here are shipped to the
executors by value, so a cluster needs no copy of the library on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
