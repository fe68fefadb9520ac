"""Row-wise and table-wise operators over a corpus of source files."""
