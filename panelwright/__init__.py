"""Research and commerce analytics as plain DataFrame-to-DataFrame jobs on Spark."""
