"""Reading tables and column dictionaries, profiling columns, writing results."""
