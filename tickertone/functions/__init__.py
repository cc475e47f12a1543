"""Pure ``Column -> Column`` building blocks."""
