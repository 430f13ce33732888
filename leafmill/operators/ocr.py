"""Lines and blocks of recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import arabic_ratio


def line_blocks(words: DataFrame, keys: list[str] = ("page",)) -> DataFrame:
    """Lines of level-5 words: text in word order, bounding box, mean confidence, share of Arabic, script.

    ``words``: keys, level, block_num, par_num, line_num, word_num, left, top, width, height, conf,
    text. Confidences under 0 don't count. Blocks are numbered by (top, left) on each page.
    """
    w = words.where("level = 5 AND trim(text) <> ''")
    group = [*keys, "block_num", "par_num", "line_num"]
    lines = w.groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("conf"),
    )
    ratio = arabic_ratio(F.col("text"))
    lines = lines.withColumns({"conf": F.floor(F.coalesce("conf", F.lit(0.0)) * 100.0 + 0.5) / 100.0, "arabic_ratio": F.floor(ratio * 1000.0 + 0.5) / 1000.0})
    script = F.when(F.col("arabic_ratio") >= 0.25, "arabic").when(F.col("arabic_ratio") >= 0.12, "mixed").otherwise("latin")
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("top", "left", "block_num", "par_num", "line_num")
    lines = lines.withColumns({"script_guess": script, "n": F.row_number().over(order)})
    page = F.col(keys[-1]).cast("int")
    return lines.select(*keys, F.format_string("p%03d_b%03d", page, "n").alias("block_id"), "text", "left", "top", "right", "bottom", "conf", "arabic_ratio", "script_guess")


def candidates(blocks: DataFrame) -> DataFrame:
    """Blocks that need Arabic recognition."""
    return blocks.where(F.col("script_guess").isin("arabic", "mixed"))
