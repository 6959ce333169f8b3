"""Plans: reports and analytics composed of the operators."""
