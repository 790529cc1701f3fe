"""Readers and writers. Every path is one that Spark reads: local, s3a or any other file system."""
