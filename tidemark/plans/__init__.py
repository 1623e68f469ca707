"""Named queries over the tables of a data folder, with equivalent SQL where SQL can say it."""
