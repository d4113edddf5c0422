"""docquarry: a PySpark-native engine that turns document collections into traceable evidence."""
