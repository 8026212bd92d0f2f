"""Analytics over scored text documents on Spark."""
