"""An embedding-collection analytics engine on Spark."""
