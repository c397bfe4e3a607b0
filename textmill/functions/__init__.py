"""Pure Column -> Column functions; all run inside Catalyst."""
