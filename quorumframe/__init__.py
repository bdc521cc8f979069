"""Analytics over collections of dated, structured documents, on Spark."""
