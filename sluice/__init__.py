"""Sluice: inspection and analytics of LLM traffic as DataFrame, Column and Structured Streaming operators."""
