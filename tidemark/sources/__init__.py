"""What is read from outside: capture timelines; and where tables are kept."""
