"""Where files come from: corpus tables, text tables and directory trees."""
