"""Configuration objects of calls: pairs at depth one of an object, however nested the rest.

Brackets are matched by a prefix scan.  One regex pass cuts a text into tokens
(comments and literals are consumed, so brackets inside them do not count); a
running sum over opening and closing brackets gives each token's depth; the
bracket around a token is then the last one opened before it at its depth.  A
second scan, over the openings of one depth, says of each object which call it
is an argument of, and a third hands that down to the object's own pairs.  All
three are windows over the tokens of one text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.core import matches


def config_tokens(text: Column, calls: Sequence[tuple] = rules.CONFIG_CALLS) -> Column:
    """Comments, literals, calls, brackets and ``url`` pairs of a masked text, in order."""
    return matches(text, rules.config_token([opening for _, opening, _ in calls], possessive=True))


def config_pairs(texts: DataFrame, calls: Sequence[tuple] = rules.CONFIG_CALLS, *,
                 text: str = "text") -> DataFrame:
    """file, kind, ord, value of each ``url`` pair of an object given to one of ``calls``.

    ``texts`` has ``file`` and a masked text.  ``value`` is the string with its
    quotes; ``ord`` numbers the pairs of a kind in a text.  Brackets that are
    never closed, or closed too often, shift depths from there on.
    """
    token = F.col("token")
    tokens = (
        texts.select(F.monotonically_increasing_id().alias("_row"), "file", F.col(text).alias("text"))
        .select("_row", "file", F.posexplode(config_tokens(F.col("text"), calls)).alias("pos", "token"))
        .where(~F.substring(token, 1, 1).isin("/", '"', "'", "`")))
    first, size = F.substring(token, 1, 1), F.length(token)
    opens = first.isin("{", "[", "(") | token.endswith("(")
    call = None  # a call's token is its opening bracket with all before it
    for kind, opening, _ in calls:
        here = token.rlike("^(?:" + opening + ")$")
        call = F.when(here, kind) if call is None else call.when(here, kind)
    rows = tokens.select(
        "_row", "file", "pos", opens.alias("opens"), (first == "{").alias("object"),
        F.when(opens & ~first.isin("{", "["), call).alias("call"),
        F.when(first.isin("{", ",") & (size > 1),
               F.regexp_extract(token, rules.CONFIG_VALUE, 1)).alias("value"),
        F.when(opens, 1).when(first.isin("}", "]", ")"), -1).otherwise(0).alias("step"))
    depth = F.sum("step").over(Window.partitionBy("_row").orderBy("pos"))
    rows = rows.select("*", depth.alias("depth")).where(F.col("opens") | F.col("value").isNotNull())
    # an object asks at the depth around it; what opens there answers
    level = Window.partitionBy("_row", "level").orderBy("pos")
    asked = rows.select("*", F.explode(F.when(F.col("object"), F.array(
        F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("up")).withColumn(
        "level", F.col("depth") - F.col("up"))
    answer = F.when((F.col("up") == 0) & F.col("opens"), F.coalesce("call", F.lit("")))
    asked = asked.withColumn("around", F.last(answer, ignorenulls=True).over(level))
    # an object's other row, at its own depth, then carries the call that it is an argument of
    named = asked.withColumn("of", F.when(F.col("up") == 1, F.col("around")))
    both = Window.partitionBy("_row", "pos")
    named = named.withColumn("of", F.max("of").over(both)).where(F.col("up") == 0)
    opened = F.when(F.col("opens"), F.when(F.col("object"), F.coalesce("of", F.lit(""))).otherwise(""))
    found = named.withColumn("kind", F.last(opened, ignorenulls=True).over(level)).where(
        F.col("value").isNotNull() & (F.col("kind") != ""))
    order = F.row_number().over(Window.partitionBy("_row", "kind").orderBy("pos")) - 1
    return found.select("file", "kind", order.alias("ord"), "value")
