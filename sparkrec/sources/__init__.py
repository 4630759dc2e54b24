"""Tables, files and event logs: readers and writers."""
