"""Spark jobs for document metadata: signatures, prompts, validation, matching, write-back and retry state."""
