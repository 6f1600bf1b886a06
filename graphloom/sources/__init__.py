"""Sources: files and tables as relations of named string columns."""
