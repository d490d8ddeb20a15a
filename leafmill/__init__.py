"""Documents of many formats as relations over one document model, and back to Markdown, on Spark."""
