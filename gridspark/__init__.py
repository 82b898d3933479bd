"""Gridded model-output analytics expressed as Spark DataFrames.

One row per grid cell; runs, output streams and records are ordinary key
columns, so every operator works over a whole parameter sweep in one job.
"""

__version__ = "0.1.0"
