"""Registry analytics on Spark: ledger ETL, keyed folds, search, rollups and snapshots."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the workers need
# neither the package nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
