"""Where rows come from and go to: text files, the log, keyed tables, staging."""
