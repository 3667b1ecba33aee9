"""Named queries: each takes (spark, folder) and returns a DataFrame; SQL twins where SQL can say it."""
