"""Readers and writers of reads, regions and results."""
