"""fieldloom: field-data, sensor and digital-twin analytics as Spark plans."""
