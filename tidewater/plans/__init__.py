"""Named queries over the tables, and the SQL that they are held against."""
