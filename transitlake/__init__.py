"""transitlake: urban-transit analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    table reads, entity bindings over the driver tables, file sinks
functions  column-level helpers (guarded division, day parsing, banding, correlation)
operators  reusable multi-step operators (factored aggregates, nesting, positional pairing)
plans      the reports (relational and document profile), dashboard tables, quality checks
streaming  intentionally empty: the reference has no streaming workload
"""

from transitlake.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
