"""rosterlab: roster- and event-style relational analytics as Spark DataFrame operators."""
