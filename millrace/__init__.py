"""millrace: capability-routed request processing expressed as PySpark dataflow."""
