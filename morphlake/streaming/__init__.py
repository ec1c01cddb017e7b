"""No operator of this library has event time, late data or state: tables are read and written in batches."""
