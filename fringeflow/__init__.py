"""Ground-deformation analytics (InSAR time series) as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Tasks carry the package's functions with them: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
