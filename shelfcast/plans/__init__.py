"""Whole analyses: the processor, the trainer, the dashboard, and the query catalogue."""
