"""Sievewall: text screening and corpus preparation as Spark jobs.

Functions of this package travel to executors by value, so a cluster needs
the Python libraries used here but no copy of the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
