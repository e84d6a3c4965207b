"""Geospatial analytics over plain Spark types.

Functions and data sources that run on executors travel by value, so the executors need only the
public libraries, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
