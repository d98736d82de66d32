"""File sources and sinks: id lists, VOC XML, detection JSON, class groups, NPZ proposals, digests."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class names that differ between the two vocabularies.
CLASS_ALIASES = {"airplane": "aeroplane", "motorcycle": "motorbike", "couch": "sofa", "potted plant": "pottedplant", "dining table": "diningtable", "tv": "tvmonitor"}

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def id_list(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """(image_id, ordinal): the first token of each non-blank line, first occurrence kept; strict raises on repeats."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("ordinal", "line"))
    ids = lines.select("ordinal", F.element_at(F.split(F.trim("line"), r"\s+"), 1).alias("image_id")).where("image_id <> ''")
    once = ids.groupBy("image_id").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n"))
    if strict and (bad := once.where("n > 1").limit(5).collect()):
        raise ValueError("repeated ids: " + ", ".join(r["image_id"] for r in bad))
    return once.select("image_id", "ordinal")


def alias(name: Column) -> Column:
    known = F.create_map(*(x for k, v in CLASS_ALIASES.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, name), name)


def voc_objects(spark: SparkSession, path: str, vocabulary: Sequence[str] | None = None) -> DataFrame:
    """(image_id, class_name, box, width, height) for every object with a box in VOC XML files.

    Names are stripped and aliased; a class outside vocabulary, if given, raises when the row is read.
    """
    schema = "size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("image_id"), F.decode("content", "UTF-8").alias("xml"))
    rows = files.select("image_id", F.from_xml("xml", schema).alias("x")).select("image_id", "x.size", F.explode("x.object").alias("o"))
    name = alias(F.trim("o.name"))
    if vocabulary is not None:
        name = F.when(name.isin(*vocabulary), name).otherwise(F.raise_error(F.concat(F.lit("class outside the vocabulary: "), name)).cast("string"))
    b = F.col("o.bndbox")
    box = F.struct(b["xmin"].alias("x1"), b["ymin"].alias("y1"), b["xmax"].alias("x2"), b["ymax"].alias("y2"))
    return rows.where("o.bndbox is not null and trim(o.name) <> ''").select("image_id", name.alias("class_name"), box.alias("box"), F.col("size.width").alias("width"), F.col("size.height").alias("height"))


def voc_classes(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, class_name) for every named object, repeats included; globs skip missing files."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("image_id"), F.decode("content", "UTF-8").alias("xml"))
    names = files.select("image_id", F.explode(F.xpath("xml", F.lit("annotation/object/name/text()"))).alias("n"))
    return names.select("image_id", F.trim("n").alias("class_name")).where("class_name <> ''")


def detection_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ground truth, detections) from {ground_truth: [...], detections: [...]}."""
    raw = spark.read.schema("ground_truth array<struct<image_id:string,class_name:string,box:array<double>>>, detections array<struct<image_id:string,class_name:string,box:array<double>,score:double>>").json(path, multiLine=True)
    box = F.struct(*(F.get("r.box", i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))
    truth = raw.select(F.posexplode("ground_truth").alias("gt_idx", "r")).select("r.image_id", F.col("gt_idx").cast("long"), "r.class_name", box.alias("box"))
    found = raw.select(F.posexplode("detections").alias("det_idx", "r")).select("r.image_id", F.col("det_idx").cast("long"), "r.score", "r.class_name", box.alias("box"))
    return truth, found


def class_groups(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, group) from a CSV with both columns; empty, repeated or conflicting rows raise ValueError."""
    raw = spark.read.option("header", True).csv(path)
    missing = {"class_name", "group"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    rows = raw.select(F.trim("class_name").alias("class_name"), F.trim("group").alias("group"))
    bad = rows.groupBy("class_name").count().where("count > 1 or class_name is null or class_name = ''").limit(5).collect()
    wrong = rows.where("group is null or group not in ('head', 'medium', 'tail')").limit(5).collect()
    if bad or wrong:
        raise ValueError(f"bad class groups: {[r[0] for r in (*bad, *wrong)]}")
    return rows


def npz_proposals(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Proposals from NPZ files, a task a file; object arrays (pickles) are refused."""
    schema = "proposal_index long, image_id string, confidence double, embedding array<double>, posterior array<double>, predicted_label long, box array<double>, objectness double"
    needed = ["image_ids", "confidence", "embeddings"] + (["posterior", "predicted_labels", "boxes", "objectness"] if strict else [])

    def load(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    lacking = [n for n in needed if n not in z.files]
                    if lacking:
                        raise ValueError(f"missing arrays: {', '.join(lacking)}")
                    n = len(z["image_ids"])

                    def column(name, z=z, n=n):
                        if name not in z.files:
                            return [None] * n
                        a = z[name]
                        if len(a) != n:
                            raise ValueError(f"{name} has {len(a)} rows, image_ids {n}")
                        if a.dtype.kind == "f" and not np.isfinite(a).all():
                            raise ValueError(f"{name} is not finite")
                        return a.tolist()

                    yield pd.DataFrame({"proposal_index": range(n), "image_id": [str(x) for x in z["image_ids"]], "confidence": column("confidence"), "embedding": column("embeddings"), "posterior": column("posterior"), "predicted_label": column("predicted_labels"), "box": column("boxes"), "objectness": column("objectness")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, schema)


def ids_digest(ids: DataFrame) -> DataFrame:
    """(digest): SHA-256 of the ids in ordinal order, one a line."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "image_id"))), lambda s: F.concat(s["image_id"], F.lit("\n"))), "")
    return ids.agg(F.sha2(text, 256).alias("digest"))


def guard(df: DataFrame, forbidden: Sequence[str] = ("class_name", "group", "is_tail", "true_class", "matched_class", "max_iou", "truth")) -> DataFrame:
    """df, if no column can hold ground truth; raises ValueError otherwise."""
    bad = [c for c in df.columns if c.lower().startswith("gt_") or c.lower() in forbidden]
    if bad:
        raise ValueError(f"ground truth in an acquisition table: {', '.join(bad)}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header; nulls are empty."""
    df.coalesce(1).write.option("header", True).option("nullValue", "").csv(path)
