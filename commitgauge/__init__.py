"""Software-maintenance analytics over version-control history, as Spark DataFrame operators."""
