"""Named queries over the standard tables, each with the SQL that it is held against."""
