"""Transaction-risk analytics expressed as PySpark DataFrame and Column functions."""
