"""Files to rows: text, CSV, DOCX, XLSX and the text of PDF streams."""
