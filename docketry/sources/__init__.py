"""Evidence adjudication engine: sources."""
