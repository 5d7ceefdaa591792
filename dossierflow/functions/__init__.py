"""Column functions: paths, text, prompts, replies, redaction."""
