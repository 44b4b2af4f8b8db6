"""Sources and sinks: strict CSV, result documents."""
