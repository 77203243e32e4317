"""Shared logical-plan building blocks used by the operators."""
