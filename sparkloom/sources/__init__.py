"""Inbound and outbound connectors."""
