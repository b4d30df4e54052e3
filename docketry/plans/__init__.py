"""Evidence adjudication engine: plans."""
