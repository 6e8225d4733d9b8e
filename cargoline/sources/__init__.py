"""Reading and writing declaration files, dictionaries, label configuration and tables."""
