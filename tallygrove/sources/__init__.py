"""Reading, writing and building the sales table."""
