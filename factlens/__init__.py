"""factlens: cloze-probe analytics on Spark DataFrames.

Facts in; prompts, ranked predictions, neighbour pools, metrics, rollups,
run summaries and belief tables out.  Every public function takes and
returns DataFrames so that Catalyst plans the whole chain.
"""

__version__ = "0.1.0"

import sys as _sys

try:  # ship this package's code to Python workers by value (no install on executors)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass
