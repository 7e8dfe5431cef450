"""Chat screens: zones, score and titles from lines with boxes (page, rec, l, t, r, b, text) and the page's width and height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

THRESHOLD = 5
# Shapes of times, words of system messages, input hints and tab bars.
TIME = r"^(?:(?:昨天|今天|星期.|周.|Yesterday|Today|Mon|Tue|Wed|Thu|Fri|Sat|Sun)\w*,? ?)?(?:上午|下午|晚上)? ?[0-9]{1,2}:[0-9]{2}(?: ?[AaPp][Mm])?$"
SYSTEM = r"撤回了一条消息|加入了?群聊|以上是打招呼的内容|joined|left the group|Messages and calls are end-to-end encrypted"
INPUT = r"^(?:发送|按住 ?说话|输入消息|Message|Type a message|iMessage|Text Message|Send)"
TABS = r"^(?:微信|通讯录|发现|我|消息|联系人|动态|首页|Chats|Calls|Status|Settings|Home|Contacts)$"


def zones(lines: DataFrame) -> DataFrame:
    """lines with `zone`: status bar, header, bottom or body, by the page's width."""
    t, w, h = F.col("t"), F.col("width"), F.col("height")
    return lines.withColumn("zone", F.when(F.col("b") <= 0.085 * w, "status").when(F.col("b") <= 0.30 * w, "header").when(t >= h - 0.17 * w, "bottom").otherwise("body"))


def scores(lines: DataFrame) -> DataFrame:
    """(page, score, is_chat): points for and against a chat, from what its lines show."""
    x = zones(lines)
    centre = F.abs(F.col("l") + F.col("r") - F.col("width")) < 0.1 * F.col("width")
    has = lambda cond: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0))
    body = F.col("zone") == "body"
    seen = x.groupBy("page", "width", "height").agg(
        has((F.col("zone") == "bottom") & F.col("text").rlike(INPUT)).alias("input"),
        F.count_distinct(F.when((F.col("zone") == "bottom") & F.col("text").rlike(TABS), F.floor(F.col("l") / 20))).alias("tabs"),
        has(body & centre & F.col("text").rlike(TIME)).alias("times"),
        has(body & F.col("text").rlike(SYSTEM)).alias("system"),
        has(body & ~centre & F.col("text").rlike(TIME) & (F.col("r") > 0.9 * F.col("width"))).alias("column"),
        has(body & (F.col("l") < 0.25 * F.col("width")) & ~centre).alias("left"),
        has(body & (F.col("r") > 0.75 * F.col("width")) & ~centre).alias("right"),
    )
    c = F.col
    score = (
        F.when(c("input") > 0, 3).otherwise(0) - F.when(c("tabs") >= 3, 4).otherwise(0) + F.least(c("times"), F.lit(2)) + F.when(c("system") > 0, 1).otherwise(0)
        + F.when((c("left") >= 2) & (c("right") >= 2), 2).otherwise(0) - F.when(c("column") >= 3, 3).otherwise(0)
    )
    portrait = c("height") > c("width")
    return seen.select("page", F.when(portrait, score).otherwise(0).alias("score")).withColumn("is_chat", F.col("score") >= THRESHOLD)


def titles(lines: DataFrame) -> DataFrame:
    """(page, title): the first line of the header without its arrow and the count behind it."""
    head = zones(lines).where((F.col("zone") == "header") & ~F.col("text").rlike(r"^[<‹〈←\s0-9:%]*$"))
    first = head.withColumn("_n", F.row_number().over(W.partitionBy("page").orderBy("t", "l"))).where("_n = 1")
    clean = F.regexp_replace(F.regexp_replace("text", r"^[<‹〈←]\s*[0-9]*\s*", ""), r"\s*[(（][0-9]+[)）]\s*$", "")
    return first.select("page", F.trim(clean).alias("title"))


def typical_height(lines: DataFrame) -> DataFrame:
    """(page, height): the element three quarters up the sorted heights of a page's lines."""
    w = W.partitionBy("page")
    h = lines.select("page", (F.col("b") - F.col("t")).alias("h"))
    ranked = h.withColumn("_n", F.row_number().over(w.orderBy("h"))).withColumn("_all", F.count("*").over(w))
    return ranked.where(F.col("_n") == F.least(F.floor(F.col("_all") * 3 / 4) + 1, F.col("_all"))).select("page", F.col("h").alias("height"))
