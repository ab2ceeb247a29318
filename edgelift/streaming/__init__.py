"""Nothing streams: a data graph is a static batch, and so is every result."""
