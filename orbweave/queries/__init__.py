"""Named queries over the test tables and, where SQL can express them, their SQL."""
