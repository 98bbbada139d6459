"""HTML pages: trees, selectors and text, for tasks that map batches of pages."""
