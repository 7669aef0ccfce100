"""A Spark-first engine for tandem-repeat screening, with an optional subpackage for training data."""
