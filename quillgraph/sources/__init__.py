"""Sources and sinks: text files, JSON and JSON-lines caches, CSV label sheets, prompt tables, schema files, fixtures."""
