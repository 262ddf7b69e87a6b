"""Ordinal vector retrieval and its analysis, as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
