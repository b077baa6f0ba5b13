"""itemspark: item-bank building and assessment analytics as Spark DataFrame operators."""
