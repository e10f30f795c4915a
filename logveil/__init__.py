"""Message-log sensitivity analytics as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

from logveil.config import Settings

# The few functions that run in Python workers travel with their tasks, so the package only
# has to be installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
