"""spanloom: Spark-first analytics over execution telemetry of LLM agents."""

__version__ = "0.1.0"
