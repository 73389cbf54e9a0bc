"""fraudlake: card-fraud data preparation, evaluation, federated-round and
monitoring operators as Spark DataFrame plans."""

import sys as _sys

__version__ = "0.1.0"

# Functions shipped to Python workers (pandas UDFs, mapInPandas,
# applyInPandasWithState) are pickled by value, so executors need no
# installed copy of this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler without the option
    pass
