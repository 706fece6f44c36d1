"""Time-series research, simulation and corpus processing on PySpark."""
