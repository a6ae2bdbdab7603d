"""The per-call jobs on transcript folders that grow."""
