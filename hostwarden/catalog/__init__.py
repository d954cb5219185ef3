"""Registered queries, each with its SQL counterpart where one exists."""
