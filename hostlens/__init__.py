"""hostlens: host telemetry analytics as Spark DataFrame plans.

Sub-packages:
  sources    file scans (counter CSV, log lines, file inventory) and sinks
  functions  column-expression helpers (time text, magnitudes, headings, sort keys)
  operators  DataFrame-in / DataFrame-out operators (series, profile, fetch, edits)
  plans      declarative specs applied with DataFrame calls (QuerySpec, FetchSpec, templates)
  streaming  Structured Streaming forms (log tail, time buckets on a stream)
"""

__version__ = "0.1.0"

import sys as _sys

try:  # ship our task-side functions by value: executors need not have the package installed
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
