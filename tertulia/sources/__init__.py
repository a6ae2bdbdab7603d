"""Readers and writers of transcripts, detections and report tables."""
