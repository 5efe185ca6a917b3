"""The registered queries over the star schema, by family; each module has QUERIES and ORACLE_SQL."""
