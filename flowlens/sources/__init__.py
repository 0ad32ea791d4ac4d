"""Readers and writers: engine logs, metadata documents, contig files, file inventories."""
