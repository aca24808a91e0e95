"""Training-data operators: quality, packing, PII, toxicity, deduplication, search, token files, decontamination, secrets.

Nothing outside this folder imports it. Every operator takes and returns DataFrames; per-batch numpy code runs inside
Spark tasks, and Spark does the partitioning, the shuffles and the joins.
"""
