"""pagelode: a PySpark engine for web-page, site and corpus analytics.

Functions that run in Python workers are pickled by value, so a session works
whether or not the package is installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
