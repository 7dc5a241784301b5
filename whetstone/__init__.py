"""A PySpark library for warehouse intelligence: operators, sources, functions, plans and streaming jobs."""
