"""Training-data operators on a `documents` table.

The functions that run inside Python tasks are shipped by value, so that executors need no installed copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
