"""Plans: catalogues and compositions of operators."""
