"""Mixing sources to target weights by entropy balancing.

Every document gets a rate w = min(cap, exp(b x)), x its tokens over the mean of its source: of all rates of at most
the cap that meet the source's token constraint, sum(w x) = goal, the ones closest to "each document once" in relative
entropy. One multiplier b for each source is the whole dual; it is convex, and Newton steps, kept inside a bracket,
solve it for all sources at once. Gradient and curvature are one map-side combined aggregate over the distinct lengths
of each source with their counts (exact, no bins), of which the driver sees one row per source. A source that has to
give all its copies has no finite multiplier: its rates are the caps. A dual that isn't solved within the steps raises.

The tilt is what the entropy asks for: a source that must shrink keeps short documents more readily than long ones, a
source that must grow repeats long ones more.

Rates become copies: the whole part, and one more for documents in the order of a hash until the tokens of the source
are reached, to within half of one document. The order is cut by a histogram over the hash and exactly within one bin of it,
so no source is ever ordered in one task.

Defined results: source names agree without case and outer white space. Documents of other sources, of none, or
without tokens aren't in the mixture. A listed source without documents has share 0; the others then share its part
in proportion. Without a given total, the mixture is as large as it can be with every source at its share. With one
that is too large, sources stop at their cap, and the report shows the shares reached. Repeated rows are documents of
their own. Empty input, empty mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import entity_key
from ..session import materialise
from .bytebpe import BYTE_BPE, VOCABULARIES, token_counts

#: Sources are the rows of the target table; more than this is taken for a mistake.
MOST_SOURCES = 10_000
BINS = 8192


@dataclass
class Source:
    share: float
    cap: float
    documents: int = 0
    tokens: int = 0
    goal: float = 0.0
    b: float = 0.0  # the multiplier of the token constraint; infinite where every copy is needed


def goals(sources: dict[str, Source], total: float | None) -> float:
    """Sets the goal of each source in tokens; returns the total."""
    have = {k: s for k, s in sources.items() if s.tokens > 0 and s.share > 0 and s.cap > 0}
    whole = sum(s.share for s in have.values())
    if not have:
        return 0.0
    if total is None:
        total = min(s.cap * s.tokens * whole / s.share for s in have.values())
    for s in have.values():
        s.goal = min(total * s.share / whole, s.cap * s.tokens)
    return total


def _small(docs: DataFrame, sources: dict, columns: dict) -> DataFrame:
    rows = [(k, *[float(f(s)) for f in columns.values()]) for k, s in sources.items()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"{len(rows)} sources; at most {MOST_SOURCES}")
    small = docs.sparkSession.createDataFrame(rows, "source string, " + ", ".join(f"{c} double" for c in columns))
    return docs.join(F.broadcast(small), "source")


class Unsolved(RuntimeError):
    """The dual wasn't solved within the steps given."""


def _rate() -> Column:
    """min(cap, exp(b x)); an infinite b is the cap itself."""
    return F.least("cap", F.exp(F.least(F.lit(50.0), F.col("b") * F.col("tokens") / F.col("mean"))))


_DUAL = {"b": lambda s: s.b, "cap": lambda s: s.cap, "mean": lambda s: s.tokens / s.documents}


def balanced(docs: DataFrame, sources: dict[str, Source], steps: int = 60, close: float = 1e-10) -> int:
    """Solves the dual; docs (source, tokens). Sets b of each source; returns the steps taken. Unsolved if they run out."""
    live = {k: s for k, s in sources.items() if s.goal > 0}
    todo = {}
    for k, s in live.items():
        s.b = 0.0
        if s.goal >= s.cap * s.tokens * (1 - 1e-12):
            s.b = math.inf
        elif abs(s.goal - min(1.0, s.cap) * s.tokens) > close * s.goal:
            todo[k] = s
    if not todo:
        return 0
    lengths = materialise(docs.where(F.col("source").isin(list(todo))).groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    bracket = {k: [-math.inf, math.inf] for k in todo}
    for step in range(1, steps + 1):
        d = _small(lengths, todo, _DUAL)
        x = F.col("tokens") / F.col("mean")
        d = d.select("source", "n", x.alias("x"), _rate().alias("w"), "cap")
        free = F.when(F.col("w") < F.col("cap"), F.col("n") * F.col("w") * F.col("x") * F.col("x")).otherwise(0.0)
        rows = d.groupBy("source").agg(F.sum(F.col("n") * F.col("w") * F.col("x")).alias("g"), F.sum(free).alias("h")).collect()  # one row per source
        for r in rows:
            s, want = todo[r["source"]], todo[r["source"]].goal * todo[r["source"]].documents / todo[r["source"]].tokens
            over = r["g"] - want
            if abs(over) <= close * want:
                s.b = round(s.b, 10)  # sums in another order must give the same copies
                del todo[r["source"]]
                continue
            low, high = bracket[r["source"]] = [s.b, bracket[r["source"]][1]] if over < 0 else [bracket[r["source"]][0], s.b]
            new = s.b - over / r["h"] if r["h"] > 0 else math.nan
            if not low < new < high:  # also where all documents are at the cap, or the curvature misleads
                new = (low + high) / 2 if math.isfinite(low + high) else 2 * s.b + (1.0 if over < 0 else -1.0)
            s.b = new
        if not todo:
            return step
    raise Unsolved(f"no rates for {', '.join(sorted(todo))} within {steps} steps")


def copies(docs: DataFrame, sources: dict[str, Source], id_: str) -> DataFrame:
    """(id_, source, tokens, rate, copies) of the documents with at least one copy. docs must be written or
    checkpointed: it is read more than once."""
    live = {k: s for k, s in sources.items() if s.goal > 0}
    d = _small(docs, live, _DUAL | {"goal": lambda s: s.goal}).withColumn("rate", _rate())
    d = d.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_), F.lit("copies")), 11).cast("double") / float(1 << 53)
    odds = u / F.col("part")
    d = d.withColumn("at", F.when(F.col("part") > 1e-9, odds / (1 + odds)))
    d = d.withColumn("bin", F.floor(F.col("at") * BINS).cast("int"))
    need = d.groupBy("source").agg((F.first("goal") - F.sum(F.col("base") * F.col("tokens"))).alias("need"))
    bins = d.where("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bin"))
    cut = bins.withColumn("upto", upto).join(need, "source").where("upto > need").groupBy("source").agg(
        F.min(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))).alias("c")
    ).select("source", F.col("c.bin").alias("edge"), F.col("c.left").alias("left")).collect()  # one row per source
    edge = {k: (BINS + 1, 0.0) for k in live} | {r["source"]: (r["edge"], r["left"]) for r in cut}
    d = _small(d, edge, {"edge": lambda e: e[0], "left": lambda e: e[1]})
    inside = d.where(F.col("bin") == F.col("edge"))
    w = W.partitionBy("source").orderBy("at", id_).rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("extra", (F.sum("tokens").over(w) - F.col("tokens") / 2 <= F.col("left")).cast("int"))
    rest = d.where(~F.coalesce(F.col("bin") == F.col("edge"), F.lit(False)))
    rest = rest.withColumn("extra", F.coalesce(F.col("bin") < F.col("edge"), F.lit(False)).cast("int"))
    out = inside.unionByName(rest).withColumn("copies", (F.col("base") + F.col("extra")).cast("int"))
    return out.where("copies > 0").select(id_, "source", "tokens", "rate", "copies")


def measured(docs: DataFrame, id_: str, text: str, source: str, folder: str = VOCABULARIES, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(id_, source, tokens) of the documents that can be mixed, checkpointed."""
    named = docs.select(F.col(id_), entity_key(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isNotNull())
    return materialise(token_counts(named, [id_, "source"], "text", folder, vocabulary).where("tokens > 0"))


def planned(sized: DataFrame, targets: DataFrame, total: float | None = None) -> dict[str, Source]:
    rows = targets.select(entity_key("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").limit(MOST_SOURCES + 1).collect()
    sources = {r["source"]: Source(float(r["target_share"] or 0), float(r["max_repeats"] or 0)) for r in rows}
    stats = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).where(F.col("source").isin(list(sources)))
    for r in stats.collect():  # one row per listed source
        sources[r["source"]].documents, sources[r["source"]].tokens = r["n"], r["t"]
    goals(sources, total)
    return sources


def mixture(docs: DataFrame, targets: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, **vocabulary) -> tuple[DataFrame, dict[str, Source]]:
    """The documents with their copies, and the plan by source."""
    sized = measured(docs, id_, text, source, **vocabulary)
    sources = planned(sized, targets, total)
    balanced(sized, sources)
    return copies(sized, sources, id_), sources


def report(mixed: DataFrame, sources: dict[str, Source]) -> DataFrame:
    """Target and reached shares by source."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    rows = [(k, s.share, int(s.cap), s.documents, int(s.tokens), s.goal) for k, s in sources.items()]
    plan = mixed.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, documents_there bigint, tokens_there bigint, goal_tokens double")
    out = plan.join(got, "source", "left")
    whole = F.sum("tokens").over(W.partitionBy())
    return out.select(
        "source", "target_share", "max_repeats", "documents_there", "tokens_there", "goal_tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"),
    )
