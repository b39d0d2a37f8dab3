"""Sources: registries and the corpora they load."""
