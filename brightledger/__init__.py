"""Company-filing analytics as plain Spark DataFrame functions."""
