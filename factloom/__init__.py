"""factloom: entity-fact analytics and corpus preparation on PySpark."""
