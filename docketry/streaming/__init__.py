"""Evidence adjudication engine: streaming."""
