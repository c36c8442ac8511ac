"""Readers and writers for cluster documents, host lists, settings files, logs and node SQL."""
