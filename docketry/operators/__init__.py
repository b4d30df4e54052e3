"""Evidence adjudication engine: operators."""
