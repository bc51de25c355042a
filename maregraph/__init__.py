"""Quality control of sensor time series as Spark plans."""
