"""Fleet telemetry analytics as Spark DataFrame functions.

Every function takes and returns DataFrames or Columns. Nothing here collects
data: the only values that reach the driver are emptiness checks and counts
that decide whether an iterative job goes on.
"""
