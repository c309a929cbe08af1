"""Reading and writing: delimited text with repair, JSON lines, the serving table."""
