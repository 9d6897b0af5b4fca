"""Generated candidate tables, JSON models, checkpoints."""
