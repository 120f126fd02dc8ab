"""tidemark: KPI monitoring and movement attribution as Spark plans."""
