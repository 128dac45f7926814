"""Reading listings and writing results."""
