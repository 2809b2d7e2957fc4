"""Training-data operators: token counts, licence scans, exact and near
duplicates, packing, personal data, byte-level BPE, language-model scores,
quality rules, language identification, repeated passages, ranked search and
Merkle manifests.

Nothing else in the library imports this package.  Functions that run in
Python workers are shipped by value, so a worker needs no copy of the package.
"""

from pyspark import cloudpickle as _cloudpickle

import retentio.llm as _this

_cloudpickle.register_pickle_by_value(_this)
