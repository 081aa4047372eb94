"""Analytics over agent trajectories, decisions and training text, as Spark jobs.

Plain ``DataFrame -> DataFrame`` functions: ``sources`` (readers, sinks, canonical views), ``operators`` (capture,
decisions, analytics, search, privacy, text), ``functions`` (column expressions), ``plans`` (registered queries with
their SQL), ``streaming`` (Structured Streaming jobs).
"""
