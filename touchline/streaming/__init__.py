"""Forms of operators that run on streams; an extension, as the batch ones work on whole matches."""
