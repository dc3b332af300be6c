"""Part of quillmill."""
