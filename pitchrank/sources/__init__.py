"""Reading, writing and keeping the pitch tables up to date."""
