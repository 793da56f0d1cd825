"""Corvane: hybrid document retrieval and corpus preparation as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have the package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
