"""matchlake: curated marts, column rules, anomaly scoring and reconciliation as Spark jobs."""

__version__ = "0.1.0"
