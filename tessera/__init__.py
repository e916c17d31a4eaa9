"""A retrieval-analytics engine on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions shipped to Python workers travel with their module's code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
