"""Detection, excerpting, classification, evaluation and reporting operators."""
