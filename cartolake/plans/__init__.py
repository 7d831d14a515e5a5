"""Registered queries, the derived tenant catalog they run on, and their SQL counterparts."""
