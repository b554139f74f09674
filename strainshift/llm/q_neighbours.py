"""op3: nearest neighbours of every hundredth vector."""

from strainshift.llm.collision_search import nearest_neighbours
from strainshift.llm.registry import query, table


@query("op3_collision_search")
def op3_collision_search(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
