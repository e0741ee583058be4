"""Readers and writers: tables, members of sample sets, snapshot archives."""
