"""Readers and writers: range-query responses, message topics, registries, documents."""
