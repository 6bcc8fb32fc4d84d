"""Part of the quillgraph engine; see README.md."""
