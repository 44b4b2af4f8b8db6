"""Plans: profiles made of operators, and their reports."""
