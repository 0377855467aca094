"""Named queries over the supplied tables, by family, with the SQL that checks them."""
