"""corpuslens: document-corpus topic modelling and citation analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, joins, aggregations and windows.  Python only runs inside tasks
where Spark has no built-in (dictionary stemming, the Gaussian-mixture E-step,
nearest-centre assignment), always over Arrow batches.
"""

import sys as _sys

# Functions that run inside tasks (mapInPandas) are shipped by value, so the
# executors' Python does not need this package on its import path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler: the package must be importable on executors
    pass

from corpuslens.session import get_session, shared_folder, stage  # noqa: E402

__all__ = ["get_session", "shared_folder", "stage"]
__version__ = "0.1.0"
