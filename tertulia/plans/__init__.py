"""The three jobs from transcripts to results, composed from the operators."""
