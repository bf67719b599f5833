"""Training-data operators. Nothing else in the library imports this folder."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
