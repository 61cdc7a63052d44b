"""Retrieval, document processing and analytics over DataFrames."""
