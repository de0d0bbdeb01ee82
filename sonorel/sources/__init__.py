"""Readers and writers: audio files, fingerprint blobs, derived signals."""
