"""Growth analytics on PySpark: click events to session, order, item and cohort
tables, governed metric requests, and a batched explanation of why a conversion
rate moved."""
