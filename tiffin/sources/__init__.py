"""Readers and writers: model tables, versioned store, events, logs, audit rows."""
