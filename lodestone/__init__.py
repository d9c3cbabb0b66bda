"""Rule-driven document mining on Spark: DataFrame operators, functions, sources, sinks, streams and stages."""

__version__ = "0.2.0"
__all__ = ["functions", "operators", "plans", "sources", "stages", "streaming"]
