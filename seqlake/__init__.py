"""seqlake: PySpark-native analytics over sequencing-style records.

Python workers unpickle the library's functions by reference when they can import it (its
parent folder is in PYTHONPATH or is the working directory); elsewhere by value, so a driver
that only extends sys.path still works.
"""

import os as _os
import sys as _sys

_root = _os.path.dirname(_os.path.dirname(_os.path.abspath(__file__)))
_seen = [_os.getcwd(), *_os.environ.get("PYTHONPATH", "").split(_os.pathsep)]
if _root not in {_os.path.realpath(p) for p in _seen if p} | {p.rstrip("/") for p in _seen}:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
