"""Readers and writers. Paths may be files, folders or globs, one or a list."""
