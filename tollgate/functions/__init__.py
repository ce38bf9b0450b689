"""tollgate."""
