"""sievework: text curation, record checking and retrieval as Spark DataFrame operators.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers, writers, guards), ``plans`` (registered
queries with their SQL), ``streaming``, and ``llm`` (operators of large
training-data pipelines, on which nothing else here depends).
"""
