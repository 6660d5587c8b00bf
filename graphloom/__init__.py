"""graphloom: graph-shaped, rule-governed analytics as Spark DataFrame plans."""
