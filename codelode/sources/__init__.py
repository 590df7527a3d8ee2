"""Readers and writers: tables, file trees, fixtures, the snapshot store."""
