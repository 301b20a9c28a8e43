"""Finance-close jobs as Spark DataFrame transformations."""
