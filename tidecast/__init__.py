"""tidecast: period demand analytics, time-series features, word importance and
item ranking as Spark DataFrame / SQL / ML / Structured Streaming jobs."""

__version__ = "0.1.0"
