"""Where records and auxiliary tables come from."""
