"""foliospark: document analytics (pages, runs, marks, searches, layouts) as Spark plans."""
