"""Readers and writers of files, logs and manifests."""
