"""Sources: captured responses -> ingest records.  Sinks: tables and files."""
