"""Conversation and recording analytics as Spark DataFrame jobs."""
