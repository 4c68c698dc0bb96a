"""Image files in and out: PNG and BMP containers, typed records, writers."""
