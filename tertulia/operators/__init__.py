"""Relational jobs on calls, turns, chunks, objections and detections."""
