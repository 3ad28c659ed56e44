"""Vector means, assembly, K-means and principal components on the test tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.ranks import DIM_MEANS, LABEL_DIM_MEANS
from shelfmark.bindings.registry import Tables, query, rounded
from shelfmark.operators import aggregate as A
from shelfmark.operators import principal as P
from shelfmark.operators import vectors as V
from shelfmark.schema import CLUSTER_SEED, CLUSTERS


@query("mean_vector", f"SELECT dim, round(mean, 6) AS mean FROM ({DIM_MEANS})")
def mean_vector(t: Tables) -> DataFrame:
    return A.mean_vector(t.embeddings, "embedding").withColumn("mean", rounded("mean"))


@query("mean_vector_per_cluster", f"SELECT label, dim, round(mean, 6) AS mean FROM ({LABEL_DIM_MEANS})")
def mean_vector_per_cluster(t: Tables) -> DataFrame:
    return A.mean_vector(t.embeddings, "embedding", ["label"]).withColumn("mean", rounded("mean"))


@query("assemble_vector", """
SELECT l_orderkey, l_linenumber, unnest([0, 1, 2, 3]) AS dim,
       unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value
FROM lineitem""")
def assemble_vector(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    assembled = V.assemble_vector(t.lineitem, columns)
    return assembled.select("l_orderkey", "l_linenumber", F.posexplode(vector_to_array("features")).alias("dim", "value"))


def _kmeans_sql(k: int, seed: int, rounds: int) -> str:
    """The same draws and rounds, one common table expression each."""
    away = "list_aggregate(list_transform(list_zip(v, c.at), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum')"
    steps = ["x AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"]
    for draw in range(k):
        time = f"-ln((CAST('0x' || substr(md5('{seed}:{draw}:' || vec_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"
        near = f"SELECT vec_id, v, min({away}) AS away FROM x, d{draw - 1} c GROUP BY vec_id, v" if draw else "SELECT vec_id, v, 1.0 AS away FROM x"
        won = f"SELECT {draw} AS cluster, v AS at FROM ({near}) WHERE away > 0 ORDER BY {time} / away, CAST(vec_id AS VARCHAR) LIMIT 1"
        steps.append(f"d{draw} AS MATERIALIZED (" + (f"SELECT * FROM d{draw - 1} UNION ALL " if draw else "") + f"(SELECT * FROM ({won})))")
    centres = f"d{k - 1}"
    nearest = lambda c: f"SELECT vec_id, v, cluster FROM (SELECT vec_id, v, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY {away}, cluster) AS pos FROM x, {c} c) WHERE pos = 1"
    for r in range(rounds):
        steps.append(f"n{r} AS MATERIALIZED ({nearest(centres)})")
        steps.append(f"""c{r} AS MATERIALIZED (
          SELECT cluster, list(mean ORDER BY dim) AS at FROM (
            SELECT cluster, dim, CAST(sum(CAST(floor(value * {V.FINE} + 0.5) AS BIGINT)) AS DOUBLE) / {V.FINE} / count(*) AS mean
            FROM (SELECT cluster, unnest(range(len(v))) AS dim, unnest(v) AS value FROM n{r}) GROUP BY cluster, dim) GROUP BY cluster)""")
        centres = f"c{r}"
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM ({nearest(centres)})"


@query("kmeans_assign", _kmeans_sql(CLUSTERS, CLUSTER_SEED, V.KMEANS_ROUNDS))
def kmeans_assign(t: Tables) -> DataFrame:
    return V.kmeans_assign(t.embeddings, "embedding", key="vec_id").select("vec_id", "cluster")


def _pca_sql(k: int, squarings: int = 18) -> str:
    """Scores by squaring the covariance matrix until one component is left, which is then taken out of it."""
    steps = ["""x AS MATERIALIZED (
      SELECT vec_id, dim, value - avg(value) OVER (PARTITION BY dim) AS value
      FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings))""",
      "c0 AS MATERIALIZED (SELECT p.dim AS i, q.dim AS j, sum(p.value * q.value) AS m FROM x p JOIN x q USING (vec_id) GROUP BY 1, 2)"]
    for n in range(k):
        last = f"c{n}"
        for s in range(squarings):
            steps.append(f"""p{n}_{s} AS MATERIALIZED (
              SELECT i, j, m / sum(CASE WHEN i = j THEN m END) OVER () AS m FROM (
                SELECT p.i, q.j, sum(p.m * q.m) AS m FROM {last} p JOIN {last} q ON p.j = q.i GROUP BY 1, 2))""")
            last = f"p{n}_{s}"
        steps.append(f"""v{n} AS MATERIALIZED (
          SELECT i AS dim, loading * sign(first_value(loading) OVER (ORDER BY abs(loading) DESC, i)) AS loading FROM (
            SELECT i, m / sqrt(top) AS loading FROM {last}, (SELECT i AS best, m AS top FROM {last} WHERE i = j ORDER BY m DESC, i LIMIT 1) WHERE j = best))""")
        steps.append(f"""c{n + 1} AS MATERIALIZED (
          SELECT i, j, m - size * a.loading * b.loading AS m FROM c{n} JOIN v{n} a ON i = a.dim JOIN v{n} b ON j = b.dim,
            (SELECT sum(m * a.loading * b.loading) AS size FROM c{n} JOIN v{n} a ON i = a.dim JOIN v{n} b ON j = b.dim))""")
    scores = ", ".join(f"round(sum(value * v{n}.loading), 6) AS pc{n + 1}" for n in range(k))
    joins = " ".join(f"JOIN v{n} USING (dim)" for n in range(k))
    return f"WITH {', '.join(steps)} SELECT vec_id, {scores} FROM x {joins} GROUP BY vec_id"


@query("pca_project", _pca_sql(2))
def pca_project(t: Tables) -> DataFrame:
    scores = P.pca_project(t.embeddings, "vec_id", "embedding")
    return scores.withColumns({c: rounded(c) for c in ("pc1", "pc2")})
