"""orrery: a Spark-native engine for 3-D scene, image-evaluation and edit-plan data."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
