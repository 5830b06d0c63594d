"""Every operator as a query over the given tables, with the SQL that states its expected result."""
