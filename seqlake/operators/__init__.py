"""DataFrame operators; column names are parameters, so they run on any table of the right shape."""
