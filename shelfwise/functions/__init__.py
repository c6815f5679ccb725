"""Column functions. None of them starts a job, so all work on streams too."""
