"""tierflow: raw, bronze, core and gold tiers of a data lake as Spark DataFrame jobs."""
