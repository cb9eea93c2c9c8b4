"""Sources and sinks: streams of bytes, tables in the shared folder, reports."""
