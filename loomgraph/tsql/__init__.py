"""Reading procedural SQL: tokens, statements, and the facts that lineage is built from."""
