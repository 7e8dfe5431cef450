"""maskwright: sensitive-information detection and redaction as Spark jobs."""
