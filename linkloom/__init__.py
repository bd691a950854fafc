"""linkloom: a PySpark-native engine for artefact links and text corpora."""
