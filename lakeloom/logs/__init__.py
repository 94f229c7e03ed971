"""Log diagnosis: parsing, rules, findings, templates, timelines, redaction."""
