"""Tables, files and the key-value log."""
