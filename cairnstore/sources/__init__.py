"""Sources: fixed schemas, relations read from driver tables, the store as a data source."""
