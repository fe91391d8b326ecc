"""Reserved: the engine has no streaming operators (each command is one batch pass)."""
