"""threadloom: chat-transcript analytics as Spark DataFrame transformations."""
