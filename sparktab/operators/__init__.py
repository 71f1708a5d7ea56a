"""DataFrame-to-DataFrame operators that aggregate, join or rank."""
