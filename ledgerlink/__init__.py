"""Payment-to-invoice matching on Spark, with batch, streaming and reporting queries."""
