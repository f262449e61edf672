"""Sources and sinks: driver-table reads, entity bindings, file formats."""
