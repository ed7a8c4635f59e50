"""Where log lines come from and where results go."""
