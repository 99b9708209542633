"""citeloom: a PySpark-native engine for bibliographic records and text corpora."""
