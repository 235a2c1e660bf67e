"""Operators for preparing training data at scale, and the queries that apply them to whole tables."""

import sys

from pyspark import cloudpickle

# Task code travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
