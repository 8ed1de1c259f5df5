"""weekloom: weekly panel analytics written as plain Spark DataFrame operators."""
