"""tidegauge: tail-aware evaluation analytics as Spark DataFrame and streaming operators."""
