"""Analytics for labelled tables whose classes are unevenly sized, on Spark."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lopside.dataset import Dataset  # noqa: E402

__all__ = ["Dataset"]
