"""Security analytics for collections of model files, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Send the few Python helpers to the executors by value, so that a cluster needs
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
