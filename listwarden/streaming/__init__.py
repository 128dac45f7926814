"""Row-local rules over streams."""
