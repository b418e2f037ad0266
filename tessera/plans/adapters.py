"""The driver's tables as geometric relations. Every key is unique and every coordinate a double."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a part of the views.
VIEWS = 500_000


class Scene:
    """Relations over the tables of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def point_views(self) -> DataFrame:
        """point_id, image_id, weight: which image sees which point. Rows come together by point, in as many parts as keep
        a part at VIEWS rows: nearly all of them are groups of their own, so tables of groups before the shuffle would hold
        whole files and save nothing, and parts made by their size in a file hold too many."""
        rows = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        parts = max(self.spark.sparkContext.defaultParallelism, rows.count() // VIEWS + 1)
        return rows.repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id")).agg(F.sum("l_quantity").alias("weight"))

    def points(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"), (10.0 + F.col("o_orderkey") % 53).alias("z"))

    def cameras(self) -> DataFrame:
        """Identity rotations, 1000 x 1000 pixels, the principal point in the middle."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("image_id"), ((k % 10) * 10.0).alias("cx"), ((k % 7) * 10.0).alias("cy"), F.lit(0.0).alias("cz"), F.lit(500.0).alias("f"), F.lit(499.5).alias("px"), F.lit(499.5).alias("py"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))

    def turned_cameras(self) -> DataFrame:
        """The cameras at several heights, with several focal lengths, turned about z by quarters."""
        k = F.col("image_id")
        quarter = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in (c, -s, 0, s, c, 0, 0, 0, 1)]) for c, s in ((1, 0), (0, 1), (-1, 0), (0, -1))]), (k % 4 + 1).cast("int"))
        return self.cameras().withColumns({"cz": (k % 5) * 4.0, "f": 450.0 + (k % 3) * 50.0, "R": quarter})

    def votes(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("point_id"), F.col("event_type").alias("label"))

    def depth(self) -> DataFrame:
        """image_id, r, c, depth, conf: 64 x 64 pixels at most, only valid ones."""
        t = self.table("lineitem")
        return t.groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 64).alias("r"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 64).alias("c")).agg(F.min(1 + F.col("l_extendedprice") % 100).alias("depth"), F.min(F.round(1 - F.col("l_discount") * 5, 4)).alias("conf"))

    def vertices(self) -> DataFrame:
        """A height field of 20 columns."""
        k = F.col("p_partkey")
        return self.table("part").select(k.alias("v_id"), (k % 20).cast("double").alias("x"), F.floor(k / 20).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"))

    def faces(self) -> DataFrame:
        """Two triangles per cell of which all corners are there. The merge join deals them over all tasks, also where the
        table is one small file."""
        v = self.vertices().select("v_id")
        corner = v.join(v.select((F.col("v_id") - 21).alias("v_id")).hint("merge"), "v_id", "left_semi").filter(F.col("v_id") % 20 < 19)
        one, two = [F.col("v_id") + d for d in (0, 1, 20)], [F.col("v_id") + d for d in (1, 21, 20)]
        both = F.array(F.struct((F.col("v_id") * 2).alias("f_id"), *[c.alias(n) for c, n in zip(one, "abc", strict=True)]), F.struct((F.col("v_id") * 2 + 1).alias("f_id"), *[c.alias(n) for c, n in zip(two, "abc", strict=True)]))
        return corner.select(F.inline(both))

    def pictures(self) -> DataFrame:
        """image_id, r, c and a grey colour: 32 vectors to a picture, a row of pixels each."""
        k = F.col("vec_id")
        rows = self.table("embeddings").select(F.floor(k / 32).cast("long").alias("image_id"), (k % 32).cast("int").alias("r"), F.posexplode("embedding").alias("c", "e"))
        grey = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + 300 * F.col("e")).cast("double")))
        return rows.select("image_id", "r", "c", *[grey.alias(x) for x in ("red", "green", "blue")])

    def wall(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Pixels, cameras, pairs and depth ranges of scenes of a flat wall at depth 10, whose grey is the vectors, smoothed
        over three rows and columns: 48 vectors a scene, seen by three cameras four columns apart, so that pixel (r, c) of
        camera k shows column c + 4 k."""
        vec = F.col("vec_id")
        e = lambda at: F.get("embedding", at)
        smooth = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda i: (e(i - 1) + e(i) + e(i + 1)).cast("double"))
        rows = self.table("embeddings").filter(F.size("embedding") == 64).select(F.floor(vec / 48).cast("long").alias("scene"), (vec % 48).cast("int").alias("r"), F.posexplode(smooth).alias("at", "e"))
        about = Window.partitionBy("scene", "at").orderBy("r").rangeBetween(-1, 1)
        rows = rows.withColumn("grey", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.avg("e").over(about))))
        shots = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("c", F.col("at") - 4 * F.col("k")).filter("c between 0 and 53")
        pixels = shots.select((F.col("scene") * 3 + F.col("k")).alias("image_id"), "r", "c", "grey")
        images = self.table("embeddings").select(F.explode(F.sequence(F.floor(vec / 48).cast("long") * 3, F.floor(vec / 48).cast("long") * 3 + 2)).alias("image_id")).distinct()
        cameras = images.select("image_id", F.lit(60.0).alias("f"), F.lit(26.5).alias("px"), F.lit(23.5).alias("py"), ((F.col("image_id") % 3) * (4 * 10 / 60)).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"))
        first = F.col("image_id") - F.col("image_id") % 3
        pairs = images.select(F.col("image_id").alias("ref_id"), F.explode(F.sequence(first, first + 2)).alias("nb_id")).filter("ref_id <> nb_id")
        return pixels, cameras, pairs, images.select("image_id", F.lit(6.0).alias("low"), F.lit(18.0).alias("high"))

    def cloud(self) -> DataFrame:
        e = lambda k: F.get("embedding", F.lit(k)).cast("double")
        return self.table("embeddings").select("vec_id", e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), "label")


#: The same relations as DuckDB's common table expressions.
SQL = {
    "pv": "pv AS (SELECT l_orderkey AS point_id, l_suppkey AS image_id, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)",
    "pt": "pt AS (SELECT o_orderkey AS point_id, (o_custkey % 97)::DOUBLE AS x, (o_orderkey % 89)::DOUBLE AS y, (10 + o_orderkey % 53)::DOUBLE AS z FROM orders)",
    "cam": "cam AS (SELECT s_suppkey AS image_id, ((s_suppkey % 10) * 10)::DOUBLE AS cx, ((s_suppkey % 7) * 10)::DOUBLE AS cy, 0::DOUBLE AS cz, 500::DOUBLE AS f, 499.5::DOUBLE AS px, 499.5::DOUBLE AS py, 1000 AS width, 1000 AS height FROM supplier)",
    # c and s: cosine and sine of the quarter by which a camera is turned
    "turn": "turn AS (SELECT s_suppkey AS image_id, ((s_suppkey % 10) * 10)::DOUBLE AS cx, ((s_suppkey % 7) * 10)::DOUBLE AS cy, ((s_suppkey % 5) * 4)::DOUBLE AS cz, (450 + (s_suppkey % 3) * 50)::DOUBLE AS f, 499.5::DOUBLE AS px, 499.5::DOUBLE AS py, 1000 AS width, 1000 AS height, CASE s_suppkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS co, CASE s_suppkey % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS si FROM supplier)",
    "votes": "votes AS (SELECT user_id AS point_id, event_type AS label FROM events)",
    "depth": "depth AS (SELECT l_suppkey AS image_id, l_partkey % 64 AS r, (l_orderkey * 7 + l_linenumber) % 64 AS c, min(1 + l_extendedprice % 100) AS depth, min(round(1 - l_discount * 5, 4)) AS conf FROM lineitem GROUP BY 1, 2, 3)",
    "v": "v AS (SELECT p_partkey AS v_id, (p_partkey % 20)::DOUBLE AS x, (p_partkey // 20)::DOUBLE AS y, p_size::DOUBLE AS z FROM part)",
    "cell": "cell AS (SELECT a.p_partkey AS k FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 21 WHERE a.p_partkey % 20 < 19)",
    "fc": "fc AS (SELECT 2 * k AS f_id, k AS a, k + 1 AS b, k + 20 AS c FROM cell UNION ALL SELECT 2 * k + 1, k + 1, k + 21, k + 20 FROM cell)",
    "cloud": "cloud AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)",
}


def with_(names: str, *more: str) -> str:
    """WITH and the named relations, then more."""
    return "WITH " + ", ".join([*(SQL[n] for n in names.split()), *more]) + " "
