"""Operators for preparing training text: deduplication, filtering, search and mixing.

Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
