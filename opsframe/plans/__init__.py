"""Proof queries: each job bound to the given tables, with its SQL counterpart."""
