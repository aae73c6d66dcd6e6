"""casework: customer-case analytics as Spark DataFrame jobs."""
