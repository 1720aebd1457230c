"""ledgerloom: procurement analytics and data preparation as Spark plans."""
