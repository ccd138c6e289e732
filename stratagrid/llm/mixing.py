"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source of ``S`` words with target ``t`` needs ``t / S`` copies of each of its documents. The
whole part is taken as it is. The fractional parts are rounded in pairs: of two documents, words
move from one fraction to the other until one of them is 0 or 1, to the side drawn with the odds
that keep both expectations. The words of a pair stay equal, so a source's total stays at its target but
for the last fraction that is left. Groups of documents fold side by side; the one
residual of each group goes up a level, where residuals are grouped again, until each
source has one group: a reduction tree whose depth is the logarithm of the largest source. At a level all sources have as many groups
as the largest needs, so that no count by source has to be joined and no group is larger than that source's.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source of
its own, the last; repeated rows count and are drawn one by one; a corpus without words takes nothing.
All draws are hashes of ids and ``seed``, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import stage
from stratagrid.operators.ordering import running

#: Documents (or residuals) that one group folds, on average.
GROUP = 256

#: Parts that a source's rows are dealt to where they meet the source's target.
SALTS = 256

#: Rows alike that are numbered at a time.
RUN = 4096

_ITEM = "struct<id:bigint,copy:bigint,size:bigint,p:double>"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target``: shares by weight, none above ``most`` times its source's size.

    Sources are ordered by cap over weight; running sums give the level that the rest would stand at if all before
    a source are full, and the first source that this level does not fill has the right one.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    w = F.element_at(cycle, ((F.col("i") - 1) % len(weights) + 1).cast("int"))
    own = stage(
        running(sizes, by_name, {"i": F.lit(1)}).select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap")),
        "sources"
    )
    total, all_w = own.agg(F.sum("source_size"), F.sum("w")).first()
    if not total:
        return own.select("source", "source_size", F.lit(0.0).alias("target"))
    fills = F.col("cap") / F.col("w")
    level = (F.lit(share * total) - (F.col("caps") - F.col("cap"))) / (F.lit(all_w) - (F.col("ws") - F.col("w")))
    ranked = running(own, [fills, *by_name], {"caps": F.col("cap"), "ws": F.col("w")}).select(
        fills.alias("fills"), *(c.alias(f"o{k}") for k, c in enumerate(by_name)), level.alias("level")
    )
    at = ranked.filter("level <= fills").agg(F.min_by("level", F.struct("fills", "o0", "o1"))).first()[0]
    return own.select("source", "source_size", (F.col("cap") if at is None else F.least("cap", F.col("w") * F.lit(at))).alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """Fold an array of fractions: ``struct<keep, done>`` with one fraction left and the settled ones."""

    def step(acc: Column, x: Column) -> Column:
        c = acc["keep"]
        cs, xs = c["size"].cast("double"), x["size"].cast("double")
        give = F.least(c["p"] * cs, (1 - x["p"]) * xs)
        take = F.least(x["p"] * xs, (1 - c["p"]) * cs)
        draw = (F.xxhash64(c["id"], c["copy"], x["id"], x["copy"], F.lit(seed)).bitwiseAND((1 << 52) - 1)).cast("double") / float(1 << 52)
        gives = draw * (give + take) < take
        moved = F.when(gives, give).otherwise(-take)
        cp, xp = _snap(c["p"] - moved / cs), _snap(x["p"] + moved / xs)
        c2 = F.struct(c["id"].alias("id"), c["copy"].alias("copy"), c["size"].alias("size"), cp.alias("p"))
        x2 = F.struct(x["id"].alias("id"), x["copy"].alias("copy"), x["size"].alias("size"), xp.alias("p"))
        settled = (cp == 0) | (cp == 1)
        return F.struct(
            F.when(settled, x2).otherwise(c2).alias("keep"), F.concat(acc["done"], F.array(F.when(settled, c2).otherwise(x2))).alias("done")
        )

    start = F.struct(items[0].alias("keep"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _snap(p: Column) -> Column:
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def size_of(text: Column) -> Column:
    """Words parted by white space; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, group: int = GROUP
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    sized = stage(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")),
        "sizes"
    )
    targets = stage(source_targets(sized, weights, share, most), "targets")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key")
    by_key = targets.select(key, "source_size", "target")

    def of_source(rows: DataFrame) -> DataFrame:
        """Rows with the figures of their source; a source's rows meet these in ``SALTS`` places, so none is too many for one."""
        salt = F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).alias("salt")
        spread = by_key.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return rows.select("*", salt).join(spread, ["key", "salt"]).drop("salt")

    blank = sized.filter("size = 0").select("id", key, "size", F.lit(0.0).alias("p"))
    # rows alike in id, source and size are interchangeable: they are counted, then numbered
    alike = sized.filter("size > 0").groupBy("id", key, "size").agg(F.count("*").alias("m"))
    runs = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(RUN).cast("long"))).alias("from"))
    copy = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN, F.col("m")) - 1)).alias("copy")
    ratio = F.col("target") / F.col("source_size")
    level = stage(
        of_source(runs.select("id", "key", "size", copy)).select(
            "key", F.struct("id", "copy", "size", _snap(ratio - F.floor(ratio)).alias("p")).alias("item")
        ),
        "fractions",
    )
    largest = level.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    settled = []
    depth = max(1, math.ceil(math.log(max(largest, 2), group)))
    for up in range(depth):
        groups = 1 if up == depth - 1 else math.ceil(largest / group ** (up + 1))
        spread = F.pmod(F.xxhash64("item.id", "item.copy", "item.size", F.lit(seed + up)), F.lit(groups))
        folded = stage(
            level.groupBy("key", spread.alias("g"))
            .agg(F.transform(
                F.sort_array(F.collect_list(F.struct(F.xxhash64("item.id", "item.copy", F.lit(seed)).alias("o"), "item"))), lambda x: x["item"]
            ).alias("items"))
            .select("key", _fold(F.col("items"), seed + up).alias("r")),
            "fold",
        )
        settled.append(folded.select("key", F.explode("r.done").alias("item")))
        level = folded.select("key", F.col("r.keep").alias("item"))
    draw = (F.xxhash64("item.id", "item.copy", F.lit(seed - 1)).bitwiseAND((1 << 52) - 1)).cast("double") / float(1 << 52)
    settled.append(level.select("key", F.col("item").withField("p", F.when(draw < F.col("item.p"), 1.0).otherwise(0.0)).alias("item")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    rows = out.select("item.id", "key", "item.size", "item.p").unionByName(blank)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")) + F.col("p").cast("long")).cast("long")
    return of_source(rows).select(
        F.col("id").alias("doc_id"), F.when(F.col("key") != "n", F.substring("key", 2, 2**31 - 1)).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
