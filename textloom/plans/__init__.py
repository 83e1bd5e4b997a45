"""Named queries over the tables, with the SQL that they are checked against."""
