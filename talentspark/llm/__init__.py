"""Training-data operators for very large text and vector tables.

Nothing outside this subpackage imports it.  Python functions of the package
travel to executors by value, so a cluster needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
