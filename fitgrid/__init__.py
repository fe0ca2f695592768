"""fitgrid: Spark-native candidate/vacancy matching and data processing."""
