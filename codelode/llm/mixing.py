"""Mixing sources to target weights: balanced sampling by the cube method.

The size of the mix is the largest at which no document is repeated more than its source allows. Every
document of a source is then wanted the same, mostly fractional, number of times: its whole part for sure, its
fraction as an inclusion probability. The flight moves the probabilities through the null space of the
balancing constraints (number of documents, tokens) until all but a few are 0 or 1; that leaves both totals of
every block as they were. Large documents are decided first. What is left of all blocks of a source flies on
together, in ever fewer blocks, and the last few documents, of all sizes but the largest, land on the choice that comes nearest
to the totals. Up to there every document's inclusion probability is kept; the landing keeps the totals instead, for
at most ``RESERVE`` + 2 documents of a source.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .tokens import VOCABULARY, token_counts

#: Undecided documents that fly together in one task.
BLOCK = 4_000
#: Documents of a source that are decided in the landing, besides the two that the flight leaves.
RESERVE = 15


def flight(p: list[float], tokens: list[int], seed: int) -> list[float]:
    """Probabilities of which all but two or fewer are 0 or 1, with the same sum and the same token total.

    Three undecided units at a time, the largest first: the direction that keeps both sums is unique, and of the
    two ends at which some unit is decided one is drawn so that each unit's probability is kept on average.
    """
    rng = random.Random(seed)
    p = list(p)
    eps = 1e-9
    waiting = [i for i, x in enumerate(p) if eps < x < 1 - eps]
    rng.shuffle(waiting)
    waiting.sort(key=lambda i: tokens[i])  # taken from the end
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            break
        i, j, k = active
        a, b, c = float(tokens[i]), float(tokens[j]), float(tokens[k])
        u = (c - b, a - c, b - a)  # sums to 0, and so does its product with the tokens
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / d if d > 0 else p[x] / -d for x, d in zip(active, u) if d)
        down = min(p[x] / d if d > 0 else (1 - p[x]) / -d for x, d in zip(active, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(active, u):
            p[x] = min(1.0, max(0.0, p[x] + step * d))
            if p[x] < eps or p[x] > 1 - eps:
                p[x] = round(p[x])
        active = [x for x in active if eps < p[x] < 1 - eps]
    return p


def landing(p: list[float], tokens: list[int]) -> list[int]:
    """0 or 1 for each of a few units: of all choices the nearest to the token and document totals."""
    n = len(p)
    if not n:
        return []
    choice = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    size = np.asarray(tokens, dtype=np.float64)
    off = np.abs(choice @ size - size @ p) / max(size.mean(), 1.0) + np.abs(choice.sum(axis=1) - sum(p)) * 0.02
    return choice[int(off.argmin())].tolist()


def reserve(p: list[float], tokens: list[int]) -> list[int]:
    """Undecided units kept back for the landing: of all sizes but the largest, so that they make up for what flies last."""
    undecided = sorted((i for i, x in enumerate(p) if 0 < x < 1), key=lambda i: (tokens[i], i))
    n = len(undecided)
    return undecided if n <= RESERVE else sorted({undecided[int(n * (0.05 + 0.8 * k / (RESERVE - 1)))] for k in range(RESERVE)})


def _fly(rows: DataFrame, turn: int, final: bool) -> DataFrame:
    def move(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("doc_id", ignore_index=True)
        seed = hash((turn, int(block["block"].iloc[0]), len(block), int(block["doc_id"].iloc[0])))
        p, tokens = block["p"].tolist(), block["tokens"].tolist()
        if final:
            held = reserve(p, tokens)
            rest = sorted(set(range(len(p))) - set(held))
            for i, x in zip(rest, flight([p[i] for i in rest], [tokens[i] for i in rest], seed)):
                p[i] = x
            left = [i for i, x in enumerate(p) if 0 < x < 1]
            for i, x in zip(left, landing([p[i] for i in left], [tokens[i] for i in left])):
                p[i] = float(x)
        else:
            p = flight(p, tokens, seed)
        return block.assign(p=p)[["doc_id", "source", "tokens", "base", "p"]]

    return rows.groupBy("source", "block").applyInPandas(move, "doc_id bigint, source string, tokens bigint, base int, p double")


def mix_documents(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens, repeats``: the documents drawn (repeats >= 1).

    ``targets`` has ``source, target_share, max_repeats``. The mix has ``total_tokens`` tokens, or as many as
    the caps allow if that is less or not given; sources that have no tokens are left out of that bound, and
    their share stays unmet. Documents whose source is NULL or not listed, with a NULL id or text, or with no
    tokens, are not drawn; repeated ids count once. Empty tables give an empty result. Only the totals of the
    listed sources come to the driver.
    """
    named = documents.where("doc_id IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    listed = named.join(wanted.select("source"), "source", "left_semi")
    sizes = token_counts(listed, ["doc_id", "source"], vocabulary=vocabulary).where("tokens > 0")
    sizes = durable(sizes.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("tokens").alias("tokens")))
    per_source = sizes.groupBy("source").agg(F.sum("tokens").alias("t")).join(wanted, "source")
    bound = per_source.agg(F.min(F.col("max_repeats") * F.col("t") / F.col("target_share")).alias("b")).first()["b"]
    total = min(bound, total_tokens) if bound is not None and total_tokens is not None else bound
    copies = F.least(F.col("target_share") * F.lit(float(total or 0)) / F.col("t"), F.col("max_repeats").cast("double"))
    rates = per_source.select("source", "max_repeats", copies.alias("copies"))
    exact = F.abs(F.col("copies") - F.round("copies")) < 1e-9
    base = F.when(exact, F.round("copies")).otherwise(F.floor("copies")).cast("int")
    rows = sizes.join(rates, "source").select("doc_id", "source", "tokens", base.alias("base"), F.when(exact, F.lit(0.0)).otherwise(F.col("copies") - F.floor("copies")).alias("p"))
    decided, todo, turn = [], rows, 0
    while True:
        undecided = todo.where("p > 0 AND p < 1")
        decided.append(todo.where("p <= 0 OR p >= 1"))
        number = undecided.groupBy("source").agg(F.count("*").alias("n"))
        most = number.agg(F.max("n")).first()[0] or 0
        if not most:
            break
        # a source that fits in one block waits for the last round, in which all sources land
        blocks = number.select("source", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(0).cast("int").alias("blocks"))
        placed = undecided.join(blocks, "source")
        if most <= BLOCK:
            decided.append(durable(_fly(placed.withColumn("block", F.lit(0)), turn, True)))
            break
        block = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("blocks")).cast("int")
        flown = _fly(placed.where("blocks > 0").withColumn("block", block), turn, False)
        todo, turn = durable(flown.unionByName(placed.where("blocks = 0").drop("blocks"))), turn + 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "tokens", (F.col("base") + F.round("p").cast("int")).alias("repeats")).where("repeats > 0")


def actual_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, documents, copies, most_repeats, tokens, actual_share`` per listed source."""
    used = drawn.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("repeats").alias("copies"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens")
    )
    used = durable(used)  # a row per source
    whole = F.lit(used.agg(F.sum("tokens")).first()[0])
    joined = targets.join(used, "source", "left").withColumn("whole", whole)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("most_repeats"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"))


def mix_faults(drawn: DataFrame, documents: DataFrame, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``source, max_repeats, unknown, repeated, beyond_cap, share_met`` per source that has been drawn from.

    A share is met if it is off by no more than ``tolerance``, or than one document of the source, as none is cut.
    """
    drawn = durable(drawn)
    own = documents.select("doc_id", "source").distinct()
    known = drawn.join(own.withColumn("known", F.lit(True)), ["doc_id", "source"], "left")
    per_document = known.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("repeats").alias("repeats"), F.max("known").alias("known"))
    count = lambda c: F.sum(c.cast("bigint"))
    checked = per_document.join(targets.select("source", "max_repeats"), "source").groupBy("source", "max_repeats").agg(
        count(F.col("known").isNull()).alias("unknown"), count(F.col("n") > 1).alias("repeated"), count(F.col("repeats") > F.col("max_repeats")).alias("beyond_cap")
    )
    largest = drawn.groupBy("source").agg(F.max("tokens").alias("largest"))
    whole = drawn.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 1
    off = F.abs(F.col("actual_share") - F.col("target_share"))
    met = (off <= tolerance) | (off * whole <= F.col("largest"))
    shares = actual_shares(drawn, targets).join(largest, "source").select("source", met.alias("share_met"))
    return checked.join(shares, "source")
