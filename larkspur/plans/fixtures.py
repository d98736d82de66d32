"""The harness tables as proposals, detections, class objects and round metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = F.col("vec_id").cast("long")
    image = F.expr("vec_id div 5")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("proposal_index"),
        F.concat(F.lit("img_"), F.lpad(image.cast("string"), 5, "0")).alias("image_id"),
        (image % 5 == 0).alias("is_reference"),
        e.alias("embedding"),
        F.transform(F.slice(e, 1, 20), F.abs).alias("posterior"),
        F.abs(F.get(e, 20)).alias("confidence"),
        F.abs(F.get(e, 21)).alias("objectness"),
        F.array(0.5 + F.get(e, 22) / 4, 0.5 - F.get(e, 23) / 4, 0.1 + F.abs(F.get(e, 24)) / 4, 0.1 + F.abs(F.get(e, 25)) / 4).alias("box_cxcywh"),
        F.col("label").cast("long").alias("predicted_label"),
        F.expr("case when vec_id % 97 = 0 then 100 + vec_id when vec_id % 89 = 0 then 5000 + vec_id div 200 else label end").cast("long").alias("skew_label"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals(spark, sf_dir).where("not is_reference")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals(spark, sf_dir).where("is_reference")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, pa = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("image_id"),
        F.col("p_brand").alias("class_name"),
        F.col("p_size").cast("long").alias("pseudo_label"),
        (F.col("l_discount").cast("double") * 10).alias("confidence"),
        F.col("l_tax").cast("double").alias("raw_novelty"),
        F.col("l_extendedprice").cast("double").alias("raw_value"),
        F.col("l_quantity").cast("double").alias("quantity"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    x, y = (e * 37) % 200, (e * 53) % 200
    return table(spark, sf_dir, "events").where("event_id % 3 = 0 and event_type <> 'error'").select(F.col("user_id").cast("string").alias("image_id"), e.cast("long").alias("gt_idx"), F.col("event_type").alias("class_name"), V.xyxy(x, y, x + 20 + e % 30, y + 20 + e % 25).alias("box"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    k = e - e % 3
    x, y = (k * 37) % 200 + e % 11, (k * 53) % 200
    box = V.xyxy(x, y, (k * 37) % 200 + 20 + k % 30, (k * 53) % 200 + 20 + k % 25)
    return table(spark, sf_dir, "events").where("(event_id % 3 = 0 and event_id % 4 <> 0) or event_type = 'error'").select(F.col("user_id").cast("string").alias("image_id"), e.cast("long").alias("det_idx"), F.col("value").cast("double").alias("score"), F.col("event_type").alias("class_name"), box.alias("box"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("image_id", "class_name")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("variant"), F.year("o_orderdate").cast("long").alias("round")).agg(F.count("*").cast("long").alias("metric"))


P_SQL = """p AS (SELECT CAST(vec_id AS BIGINT) AS proposal_index, 'img_' || lpad(CAST(vec_id // 5 AS VARCHAR), 5, '0') AS image_id, (vec_id // 5) % 5 = 0 AS is_reference,
 list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding, list_transform(embedding[1:20], lambda x: abs(CAST(x AS DOUBLE))) AS posterior,
 abs(CAST(embedding[21] AS DOUBLE)) AS confidence, abs(CAST(embedding[22] AS DOUBLE)) AS objectness, CAST(label AS BIGINT) AS predicted_label,
 CAST(CASE WHEN vec_id % 97 = 0 THEN 100 + vec_id WHEN vec_id % 89 = 0 THEN 5000 + vec_id // 200 ELSE label END AS BIGINT) AS skew_label FROM embeddings),
c0 AS (SELECT * FROM p WHERE NOT is_reference), r0 AS (SELECT * FROM p WHERE is_reference),
c AS (SELECT *, list_transform(embedding, lambda x: x / greatest(sqrt(list_dot_product(embedding, embedding)), 1e-12)) AS unit FROM c0),
r AS (SELECT *, list_transform(embedding, lambda x: x / greatest(sqrt(list_dot_product(embedding, embedding)), 1e-12)) AS unit FROM r0)"""

L_SQL = """li AS (SELECT CAST(l_orderkey AS VARCHAR) AS image_id, p_brand AS class_name, CAST(p_size AS BIGINT) AS pseudo_label, CAST(l_discount AS DOUBLE) * 10 AS confidence,
 CAST(l_tax AS DOUBLE) AS raw_novelty, CAST(l_extendedprice AS DOUBLE) AS raw_value, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"""

D_SQL = """gt AS (SELECT CAST(user_id AS VARCHAR) AS image_id, event_id AS gt_idx, event_type AS class_name, CAST(event_id * 37 % 200 AS DOUBLE) AS x1, CAST(event_id * 53 % 200 AS DOUBLE) AS y1,
 CAST(event_id * 37 % 200 + 20 + event_id % 30 AS DOUBLE) AS x2, CAST(event_id * 53 % 200 + 20 + event_id % 25 AS DOUBLE) AS y2 FROM events WHERE event_id % 3 = 0 AND event_type <> 'error'),
k AS (SELECT *, event_id - event_id % 3 AS k FROM events WHERE (event_id % 3 = 0 AND event_id % 4 <> 0) OR event_type = 'error'),
det AS (SELECT CAST(user_id AS VARCHAR) AS image_id, event_id AS det_idx, CAST(value AS DOUBLE) AS score, event_type AS class_name, CAST(k * 37 % 200 + event_id % 11 AS DOUBLE) AS x1, CAST(k * 53 % 200 AS DOUBLE) AS y1,
 CAST(k * 37 % 200 + 20 + k % 30 AS DOUBLE) AS x2, CAST(k * 53 % 200 + 20 + k % 25 AS DOUBLE) AS y2 FROM k),
over_ AS (SELECT d.det_idx, g.gt_idx, d.class_name AS dn, g.class_name AS gn, greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS inter,
 greatest(d.x2 - d.x1, 0) * greatest(d.y2 - d.y1, 0) AS da, greatest(g.x2 - g.x1, 0) * greatest(g.y2 - g.y1, 0) AS ga FROM det d JOIN gt g USING (image_id)),
iou AS (SELECT det_idx, gt_idx, dn, gn, CASE WHEN da + ga - inter <= 0 THEN 0 ELSE inter / (da + ga - inter) END AS iou FROM over_)"""
