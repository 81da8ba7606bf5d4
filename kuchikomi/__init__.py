"""Review analytics as PySpark DataFrame operators.

Sub-packages:

* ``functions`` -- column expressions (text, scores, time, tokens, hashing)
* ``sources``   -- readers and writers
* ``operators`` -- DataFrame to DataFrame transformations
* ``streaming`` -- incremental ingest with Structured Streaming
* ``plans``     -- whole jobs composed from the operators, and the query catalogue
"""
