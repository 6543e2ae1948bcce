"""File intake, canonical tables and table comparison."""
