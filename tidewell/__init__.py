"""Analytics over large, multi-user collections of timestamped wearable samples, as Spark DataFrame operators."""
