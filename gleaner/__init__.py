"""Analysis and curation of repeatedly harvested catalogue tables, as DataFrame operations."""

import sys

from pyspark import cloudpickle

# what runs in tasks is shipped by value: workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
