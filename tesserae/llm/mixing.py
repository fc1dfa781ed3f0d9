"""Mixing sources to target shares of all tokens.

Every source has a rate, the number of copies of each of its documents that would give it its share of the largest mix
that respects all caps. The whole part of the rate is copied outright. The fractional part of every document, whatever its
size, is rounded by pivotal dependent rounding: two fractional probabilities exchange mass, in tokens, in a random
direction until one of them is 0 or 1; the direction is chosen so that every probability keeps its expectation, while the
source's tokens stay fixed. Blocks of documents are rounded on their own: a document, the largest first, against the pool
of all smaller ones, which share one probability, so that these make up for what it takes or leaves (`pooled`). A block
leaves at most one open document; a reduction tree over the blocks combines those two by two (`pivotal`), and one last
document per source is rounded by a coin. So a source's tokens differ from its goal by less than one document, a small
one unless no others could make up for a large one.

Defined results: documents of null or unlisted sources are not in the mix; null and empty texts have no tokens and get 0
copies; repeated rows are separate documents; a listed source without tokens gets share 0 and the other shares are
scaled up; targets with a null or non-positive share or max_repeats below 1 are ignored, of repeated ones the largest
counts; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from .bpe import TOKENIZER_DIR
from .encode import TOKENIZER, token_counter

BLOCK_DOCS = 20_000
FAN_IN = 64


def pivotal(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round probabilities p with weights w; sum(p w) is kept but for at most one element left fractional."""
    p, w = p.astype(float).tolist(), w.astype(float).tolist()
    i = -1
    for j, draw in enumerate(rng.random(len(p)).tolist()):
        if not 0 < p[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        room, mass = (1 - p[i]) * w[i], p[i] * w[i]
        gives, takes = p[j] * w[j], (1 - p[j]) * w[j]
        up, down = min(room, gives), min(mass, takes)  # what i can get from j, and give to it
        if draw * (up + down) < down:
            p[i] = 1.0 if up == room else p[i] + up / w[i]
            p[j] = 0.0 if up == gives else p[j] - up / w[j]
        else:
            p[i] = 0.0 if down == mass else p[i] - down / w[i]
            p[j] = 1.0 if down == takes else p[j] + down / w[j]
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return np.array(p)


def pooled(p: float, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round documents of weights w, all of probability p, each against the pool of those after it; p sum(w) is kept but
    for at most one element left fractional."""
    out = np.zeros(len(w))
    w = w.astype(float)
    rests = (np.cumsum(w[::-1])[::-1] - w).tolist()
    for i, (mass, rest, draw) in enumerate(zip(w.tolist(), rests, rng.random(len(w)).tolist())):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i:] = round(p)
            break
        if rest <= 0:
            out[i] = p
            break
        up, down = min((1 - p) * mass, p * rest), min(p * mass, (1 - p) * rest)  # what i can get from the pool, and give to it
        if draw * (up + down) < down:
            if up < (1 - p) * mass:  # the pool is empty, i stays open
                out[i] = p + up / mass
                break
            out[i], p = 1.0, p - up / rest
        else:
            if down < p * mass:  # the pool is full
                out[i], out[i + 1 :] = p - down / mass, 1.0
                break
            p += down / rest
    return out


def _round_group(seed: int, first: bool):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tokens", "draw", "doc_id"], ascending=[False, True, True], ignore_index=True)
        rng = np.random.default_rng([seed, int(g["draw"].iloc[0]) & 0x7FFFFFFF, int(g["block"].iloc[0])])
        w = g["tokens"].to_numpy(float)
        g["p"] = pooled(float(g["p"].iloc[0]), w, rng) if first else pivotal(g["p"].to_numpy(), w, rng)
        return g

    return run


_SCHEMA = "doc_id long, source string, tokens long, base int, draw long, block int, p double"


def document_sizes(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens) of the documents of listed sources."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", F.col(text_col).alias("text"))
    listed = targets.filter("source is not null").select("source").distinct()
    return spread(src).join(F.broadcast(listed), "source", "left_semi").select("doc_id", "source", "text").mapInArrow(token_counter(name, folder), "doc_id long, source string, tokens long")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, **columns) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document of a listed source."""
    sizes = staged(document_sizes(docs, targets, **columns))
    spark = sizes.sparkSession
    rules = targets.filter("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # one row per listed source: bounded by the table of targets
    stats = sizes.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).join(rules, "source").collect()
    whole = sum(r["target_share"] for r in stats)
    total = min((r["tokens"] * r["max_repeats"] * whole / r["target_share"] for r in stats), default=0.0)
    rates = {r["source"]: min(r["max_repeats"], total * r["target_share"] / whole / r["tokens"]) for r in stats}
    blocks = {r["source"]: -(-r["docs"] // BLOCK_DOCS) for r in stats}
    plan = spark.createDataFrame([(s, *_parts(r), blocks[s]) for s, r in sorted(rates.items())], "source string, base int, part double, blocks int")
    some = F.col("tokens") > 0
    start = (
        sizes.join(F.broadcast(plan), "source", "left")
        .withColumn("draw", F.xxhash64("doc_id", "source", F.lit(seed)))
        .select(
            "doc_id", "source", "tokens", F.when(some, F.coalesce("base", F.lit(0))).otherwise(0).alias("base"), "draw",
            F.pmod("draw", F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.when(some, F.coalesce("part", F.lit(0.0))).otherwise(0.0).alias("p"),
        )
    )
    done = start.filter("p = 0")
    left = start.filter("p > 0")
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    width, level = max(blocks.values(), default=1), 0
    while level == 0 or width > 1:  # as many rounds as the reduction tree has levels
        if level:
            left, width = left.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int")), -(-width // FAN_IN)
        rounded = staged(left.groupBy("source", "block").applyInPandas(_round_group(seed + level, level == 0), _SCHEMA))
        done, left, level = done.unionByName(rounded.filter(~is_open)), rounded.filter(is_open), level + 1
    coin = F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    last = left.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0))
    return done.unionByName(last).select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("copies"))


def _parts(rate: float) -> tuple[int, float]:
    near = round(rate)
    if abs(rate - near) < 1e-9:
        return int(near), 0.0
    return int(rate), rate - int(rate)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, documents, max_copies) of every target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"), F.max("copies").alias("max_copies"))
    every = got.agg(F.sum("tokens").alias("all"))
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    joined = t.join(got, "source", "left").withColumn("one", F.lit(1)).join(F.broadcast(every.withColumn("one", F.lit(1))), "one")
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))


def bounds(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, capped, rounded, on_goal) of every listed source: no document over max_repeats; copies of its documents
    differ by one at most; tokens differ from the share of the whole by less than its largest document (and the shares
    missed by the others)."""
    rules = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    used = mixed.filter("tokens > 0")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.max("copies").alias("most"), F.min("copies").alias("fewest"), F.max("tokens").alias("largest"))
    j = got.join(rules, "source").withColumn("one", F.lit(1))
    every = j.groupBy("one").agg(F.sum("got").alias("all"), F.sum("largest").alias("slack"), F.sum("target_share").alias("whole"))
    j = j.join(F.broadcast(every), "one")  # a row
    on_goal = F.abs(F.col("got") - F.col("all") * F.col("target_share") / F.col("whole")) <= F.col("largest") + F.col("slack") * F.col("target_share") / F.col("whole")
    return j.select("source", (F.col("most") <= F.col("max_repeats")).alias("capped"), (F.col("most") - F.col("fewest") <= 1).alias("rounded"), on_goal.alias("on_goal"))
