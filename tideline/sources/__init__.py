"""Reading and writing: snapshots, window seeds, tables."""
