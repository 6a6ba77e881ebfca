"""Query catalogue: every operator as a runnable query with, where SQL can say it, an oracle."""
