"""agentlake: a PySpark-native engine for the data that AI assistants read and leave behind."""
