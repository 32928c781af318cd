"""Table preparation, data quality and chain evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tableprep.functions.columns import Roles
from tableprep.session import get_session

# Functions sent to Python workers carry their code along, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Roles", "get_session"]
