"""Sources and sinks: typed table reads, JSON intake, directory pages, id-assigning appends, schema conform."""
