"""Patient-monitoring analytics as plain Spark DataFrame jobs.

Sub-packages: ``sources`` (readers, line parsers, sinks), ``functions`` (column
expressions), ``plans`` (skew-safe ordered scans and interval joins),
``operators`` (vitals, fusion, prescriptions, speech, motion, boxes, quality,
registry) and ``streaming`` (the stateful parts as Structured Streaming jobs).
"""
