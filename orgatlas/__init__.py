"""Company lists and company profiles in bulk, as Spark DataFrame jobs."""
