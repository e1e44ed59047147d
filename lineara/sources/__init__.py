"""Readers and writers: landed blocks, access logs, token lists, snapshots and a small key-value table."""
