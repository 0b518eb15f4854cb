"""Problem 9: documents mixed from overlapping sources towards target shares.

Documents of the same text are one document that belongs to several sources. They are aggregated by
membership pattern (the set of sources), and a min-cost flow on the patterns routes token capacity to the
quotas of the sources: the r-th use of a pattern's documents costs r - 1 (convex), so that nothing is
repeated while fresh documents are left, and no pattern gives a source more than ``max_repeats`` uses.
The flow network has a node for each pattern and source and doesn't grow with the documents.

Then documents are selected by a seeded order: a pattern's documents lie on a line as long as their tokens,
each use of the pattern is one pass along it, and the flow to each source is a stretch of that path. The
position of a document is a running sum in two levels (over bins of the seeded hash, then inside the bin),
so that no pattern is ordered in one task, however large it is.

Documents without a source, with a source that has no target, without text or of no tokens take no part.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
SEED = 11
#: Documents of a pattern in one bin of the seeded order, on average.
PER_BIN = 20_000

# --- fixed value: the public pattern that splits text before byte-pair merging ------------------------------
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(text_id, source, tokens) of every document; text_id is a 128-bit hash of the text."""
    path = f"{tokenizers}/{VOCABULARY}"

    def run(cols: dict[str, list]) -> dict[str, list]:
        encode = encoding(path).encode_ordinary
        texts = cols["text"]
        return {"text_id": [xxhash.xxh3_128_digest(t) for t in texts], "source": cols["source"], "tokens": [len(encode(t)) for t in texts]}

    rows = documents.where("source IS NOT NULL AND text IS NOT NULL AND text <> ''").select("source", "text")
    return map_batches(rows, "text_id binary, source string, tokens long", run)


class Flow:
    """Min-cost maximal flow by successive shortest paths with potentials; capacities and costs are whole numbers."""

    def __init__(self) -> None:
        self.nodes: dict[object, int] = {}
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def node(self, name: object) -> int:
        if name not in self.nodes:
            self.nodes[name] = len(self.out)
            self.out.append([])
        return self.nodes[name]

    def arc(self, a: object, b: object, cap: int, cost: int) -> int:
        i, j = self.node(a), self.node(b)
        for x, y, c, w in ((i, j, cap, cost), (j, i, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, start: object, end: object) -> int:
        s, t = self.node(start), self.node(end)
        high = [0] * len(self.out)
        total = 0
        while True:
            far = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.cap[e] > 0:
                        y, nd = self.to[e], d + self.cost[e] + high[x] - high[self.to[e]]
                        if far[y] is None or nd < far[y]:
                            far[y], via[y] = nd, e
                            heapq.heappush(heap, (nd, y))
            if far[t] is None:
                return total
            high = [h + (far[t] if f is None else min(f, far[t])) for h, f in zip(high, far, strict=True)]
            push, x = None, t
            while x != s:
                e = via[x]
                push = self.cap[e] if push is None else min(push, self.cap[e])
                x = self.to[e ^ 1]
            x = t
            while x != s:
                e = via[x]
                self.cap[e] -= push
                self.cap[e ^ 1] += push
                x = self.to[e ^ 1]
            total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """(pattern, source) -> tokens: flow of least repetition that fills as much of the quotas as can be filled."""
    flow = Flow()
    arcs: dict[tuple[tuple[str, ...], str], int] = {}
    for p, tokens in sorted(patterns.items()):
        most = max(targets[s][1] for s in p)
        for r in range(most):
            flow.arc("start", ("pattern", p), tokens, r)
        for s in p:
            arcs[p, s] = flow.arc(("pattern", p), ("source", s), tokens * targets[s][1], 0)
    for s, (share, _) in sorted(targets.items()):
        flow.arc(("source", s), "end", int(share * total), 0)
    flow.run("start", "end")
    return {k: flow.cap[e ^ 1] for k, e in arcs.items() if flow.cap[e ^ 1] > 0}


def mixed(spark: SparkSession, sf_dir: str, total: int | None = None, tokenizers: str = TOKENIZERS, seed: int = SEED) -> tuple[DataFrame, dict[str, tuple[float, int]], int]:
    """((text_id, source, uses, tokens) of the selected documents, targets, size aimed at). The size is that of all
    distinct documents with a source unless it is given."""
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()}
    counted = token_counts(table(spark, sf_dir, "documents").where(F.col("source").isin(list(targets))), tokenizers)
    texts = stage(
        counted.where("tokens > 0").groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("pattern"), F.max("tokens").alias("tokens")), "texts"
    )
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()
    patterns = {tuple(r["pattern"].split("\x1f")): r["tokens"] for r in sums}
    total = sum(patterns.values()) if total is None else total
    flow = route(patterns, targets, total)
    # stretches of each pattern's path: (pattern, source, from, to), and its length
    rows, at = [], dict.fromkeys(patterns, 0)
    for (p, s), f in sorted(flow.items()):
        rows.append(("\x1f".join(p), s, at[p], at[p] + f, patterns[p]))
        at[p] += f
    # one row per pattern and source: bounded by the patterns, as the flow is
    stretches = spark.createDataFrame(rows, "pattern string, source string, begin long, stop long, length long")
    bins = {r["pattern"]: 1 + r["docs"] // PER_BIN for r in sums}
    n_bins = spark.createDataFrame([(p, n) for p, n in bins.items()], "pattern string, bins long")
    order = F.xxhash64("text_id", F.lit(seed))
    placed = texts.join(F.broadcast(n_bins), "pattern").withColumn("o", order).withColumn("bin", F.pmod("o", "bins"))
    before = placed.groupBy("pattern", "bin").agg(F.sum("tokens").alias("t"))
    up = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("pattern", "bin", F.coalesce(F.sum("t").over(up), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "bin").orderBy("o", "text_id").rowsBetween(Window.unboundedPreceding, -1)
    position = placed.join(before, ["pattern", "bin"]).select("pattern", "text_id", "tokens", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("at"))
    # uses of a document by a source: the passes on which its beginning falls into the source's stretch
    passes = F.ceil((F.col("stop") - F.col("at")) / F.col("length")) - F.ceil((F.col("begin") - F.col("at")) / F.col("length"))
    chosen = position.join(F.broadcast(stretches), "pattern").withColumn("uses", passes.cast("int")).where("uses > 0").select("text_id", "source", "uses", "tokens")
    return chosen, targets, total


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with its target and the share it gets, the documents taken, how often at most, and the tokens."""
    chosen, targets, total = mixed(spark, sf_dir)
    got = chosen.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens")
    )
    goal = spark.createDataFrame([(s, share, m, int(share * total)) for s, (share, m) in sorted(targets.items())], "source string, target_share double, max_repeats int, quota long")
    out = goal.join(got, "source", "left").na.fill(0, ["documents", "uses", "most_uses", "tokens"])
    # one row per source
    return out.withColumn("actual_share", F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(Window.partitionBy(F.lit(1)))))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selected document with the source it is taken for and how often."""
    chosen, _, _ = mixed(spark, sf_dir)
    return chosen.select(F.hex("text_id").alias("text_id"), "source", "uses", "tokens")


QUERIES = {"p9_documents": p9_documents, "p9_mix": p9_mix}
