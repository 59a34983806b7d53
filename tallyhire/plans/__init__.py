"""Public views: the queries a user of the engine runs."""
