"""tollgate: prompt and response screening on Spark.

Detect personal data with exact positions and mask it, score prompt
injection, check responses for toxicity, blocked topics and required JSON
fields, decide one verdict per row under a policy, keep an audit log and
aggregate it -- all as DataFrame/Column expressions, batch and streaming.
"""

__version__ = "0.1.0"
