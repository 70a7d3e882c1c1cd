"""lacuna: Spark-native recommendation over incomplete tabular data.

Every step (cleaning, encoding, splitting, missingness injection, imputation,
recommenders, ranking, metrics, reports) is a DataFrame transformation; learned
state is small (per-class moments, vocabularies, weight vectors) and is carried
as literals or size-checked broadcast tables.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python kernels travel inside the task closure, so executors need neither this
# package on their path nor a particular working directory.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from lacuna.session import get_session, checkpoint_dir, cut_lineage  # noqa: F401,E402
from lacuna.spec import FeatureSpec  # noqa: F401,E402

__all__ = ["get_session", "checkpoint_dir", "cut_lineage", "FeatureSpec"]
