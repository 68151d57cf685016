"""Reading corpora of markdown notes, and committing states as versions."""
