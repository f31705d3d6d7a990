"""Readers that produce the canonical observation table."""
