"""voltaflow: multichannel time-series and event analytics on PySpark."""
