"""pulsemill: telemetry warehousing on PySpark.

Plain functions over DataFrames: snapshots of cumulative counters become
deltas, state observations become histories, run logs become rollups, and
everything meets in a star schema.
"""
