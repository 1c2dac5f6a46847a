"""tagtrail: session-based product recommendation analytics on Spark.

Every public function maps DataFrame -> DataFrame or Column -> Column and
only builds a logical plan; nothing is collected to the driver.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions travel to the workers by value, so the package need not be on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
