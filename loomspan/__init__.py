"""loomspan: card-catalogue, embedding-cluster and deck analytics as Spark DataFrame operators."""
