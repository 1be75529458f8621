"""Readers and writers: sample files, output listings, manifests, response logs, run history."""
