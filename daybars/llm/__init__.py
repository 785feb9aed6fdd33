"""Training-data operators: scans, deduplication, mixing, classifiers.

Nothing outside this folder imports it; its driver queries are in
``daybars.llm.registry``.
"""
