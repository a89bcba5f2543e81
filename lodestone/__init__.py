"""Lodestone: document retrieval, answer validation and corpus preparation as Spark DataFrame operators."""
