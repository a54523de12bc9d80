"""Entities, the query registry and shared storage; `catalogue` has all registered queries."""
