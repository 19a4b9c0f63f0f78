"""A PySpark engine for evaluating long-form audio question answering."""
