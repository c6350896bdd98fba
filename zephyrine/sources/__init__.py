"""Where rows come from and go to: files, the versioned store, JSON rows and output formats."""
