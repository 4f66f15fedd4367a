"""Sources: repositories, git, exported graphs."""
