"""Evidence adjudication engine: functions."""
