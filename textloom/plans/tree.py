"""Directory trees, set-based: glyphs from a window over siblings, indents by a join with the directories above."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors

TEE, ELBOW, BAR, GAP = "├── ", "└── ", "│   ", "    "


def tree_rows(files: DataFrame, kept: DataFrame | None = None, *, last_of_kept: bool = False) -> DataFrame:
    """(rel_path, parts, line): a text line for each kept entry, to be read in the order of parts.

    By default an entry is the last of its siblings among all that were listed, kept or not, so a directory whose last
    entry is filtered out shows no elbow; with last_of_kept, among those kept.
    """
    kept = files if kept is None else kept
    listed = kept if last_of_kept else files
    one = Window.partitionBy("parent")
    last = listed.select("rel_path", "parent", (F.col("name") == F.max("name").over(one)).alias("is_last"))
    rows = kept.select("rel_path", "parts", "parent", "name", "is_dir").join(last.select("rel_path", "is_last"), "rel_path")
    above = rows.select("rel_path", F.posexplode(ancestors(F.col("rel_path"))).alias("level", "a"))
    dirs = last.select(F.col("rel_path").alias("a"), F.when(F.col("is_last"), GAP).otherwise(BAR).alias("step"))
    indent = above.join(dirs, "a").groupBy("rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "step"))), lambda x: x["step"]), "").alias("indent"))
    line = F.concat(F.coalesce("indent", F.lit("")), F.when(F.col("is_last"), ELBOW).otherwise(TEE), "name", F.when(F.col("is_dir"), "/").otherwise(""))
    return rows.join(indent, "rel_path", "left").select("rel_path", "parts", line.alias("line"))


def tree_json_rows(kept: DataFrame, *, root_name: str) -> DataFrame:
    """(ord, token): JSON of the nested entries in pieces; joined in the order of ord they are one document.

    A directory closes after all below it: its closing piece sorts by its own parts followed by a mark above any name.
    """
    one = Window.partitionBy("parent").orderBy("name")
    sibling = kept.select("parts", "name", "is_dir", "parent", F.row_number().over(one).alias("no"), F.count("*").over(Window.partitionBy("parent")).alias("of"))
    has = kept.groupBy(F.col("parent").alias("p")).agg(F.lit(True).alias("full"))
    nodes = sibling.join(has, F.array_join("parts", "/") == F.col("p"), "left").select("parts", "name", "is_dir", "no", F.coalesce("full", F.lit(False)).alias("full"))

    def quoted(c):
        j = F.to_json(F.struct(c.alias("n")))
        for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
            j = F.replace(j, F.lit(sign), F.lit(code))
        return F.substring(j, 6, F.length(j) - 6)

    comma = F.when(F.col("no") > 1, ",").otherwise("")
    start = F.concat(comma, F.lit('{"name":'), quoted(F.col("name")), F.lit(',"type":"'), F.when(F.col("is_dir"), "directory").otherwise("file"), F.lit('"'), F.when(F.col("full"), ',"children":[').otherwise("}"))
    opened = nodes.select(F.col("parts").alias("ord"), start.alias("token"))
    closed = nodes.where("full").select(F.concat("parts", F.array(F.lit("\U0010ffff"))).alias("ord"), F.lit("]}").alias("token"))
    spark = kept.sparkSession
    top = spark.createDataFrame([(root_name,)], "name string").select(F.array().cast("array<string>").alias("ord"), F.concat(F.lit('{"name":'), quoted(F.col("name")), F.lit(',"type":"directory"')).alias("token"))
    some = kept.agg((F.count("*") > 0).alias("some"))
    head = top.crossJoin(some).select("ord", F.concat("token", F.when(F.col("some"), ',"children":[').otherwise("}")).alias("token"))
    foot = some.where("some").select(F.array(F.lit("\U0010ffff"), F.lit("\U0010ffff")).alias("ord"), F.lit("]}").alias("token"))
    return head.unionByName(opened).unionByName(closed).unionByName(foot)
