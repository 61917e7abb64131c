"""Plan building blocks: scratch tables, arrival chunks, chunked running values, the fold."""
