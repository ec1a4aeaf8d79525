"""Temperature mixing of sources.

Source shares of all tokens are raised to an exponent (1: as they are, 0: all sources alike) and
normalised. The exponent, a multiple of 1/STEPS (the resolution of the search), is the largest at which the entropy of the weights
reaches its target; if then some source would be read more often than the limit, the smallest at which
it is not. Each source's token budget is met by whole passes over its rows, every pass (block) in a
seeded order of its own, and a last block that takes rows in order while the budget holds them. Weights
and budgets are whole numbers, and budgets sum to the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.scratch import buckets_for, range_of, running, uniform, written

STEPS = 4096
FANOUT = 64
#: Weights are whole numbers of this fraction.
SCALE = 1 << 40
ENTROPY = 0.999
#: Up to so many sources their cuts are broadcast (some hundred bytes each); beyond, rows are joined by source.
FEW_SOURCES = 1 << 15
MAX_REPEATS = 4.0


def n_tokens(text: str = "text"):
    """Words between white space; null: none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weight(k: Column | int, t_src: Column, total: int) -> Column:
    """The weight of a source with ``t_src`` of ``total`` tokens at exponent k / STEPS, as a whole number.

    At exponent 1 it is the source's tokens, so that a budget of all tokens gives every source just its own.
    """
    k = F.lit(k) if isinstance(k, int) else k
    power = F.pow(t_src / F.lit(float(max(1, total))), k / F.lit(float(STEPS)))
    return F.when(k == STEPS, t_src).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(power * F.lit(float(SCALE))).cast("long")))


def _at(totals: DataFrame, total: int, ks: list[int]) -> dict[int, tuple[float, float]]:
    """For each exponent k / STEPS: entropy over its maximum, and the most passes over a source per unit of budget.

    Sums are of whole numbers, so no order of addition changes them.
    """
    grid = totals.select((F.col("t_src") / F.lit(float(max(1, total)))).alias("share"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    e = F.col("k") / F.lit(float(STEPS))
    whole = lambda c: F.sum(F.floor(c * F.lit(float(SCALE))).cast("decimal(20,0)")).cast("double")
    sums = grid.groupBy("k").agg(
        whole(F.pow("share", e)).alias("z"), whole(F.pow("share", e) * F.log("share")).alias("a"),
        F.max(F.pow("share", e - 1)).alias("top"), F.count("*").alias("n"),
    )
    z = F.col("z") / F.lit(float(SCALE))
    done = sums.select("k", (F.log(z) - e * F.col("a") / F.col("z")).alias("h"), F.log("n").alias("most"), (F.col("top") / z).alias("r"))
    return {r.k: (1.0 if r.most == 0 else r.h / r.most, r.r) for r in done.collect()}


def exponent(totals: DataFrame, total: int, budget_share: float, entropy: float, max_repeats: float) -> int:
    """k of the exponent k / STEPS. Both measures are monotone in k, so FANOUT-way section halves six times a pass."""
    ok: dict[int, tuple[float, float]] = {}
    lo = list(range(0, STEPS + 1, STEPS // FANOUT))
    ok |= _at(totals, total, lo)

    def even(k: int) -> bool:
        return ok[k][0] >= entropy - 1e-9

    def spare(k: int) -> bool:
        return ok[k][1] * budget_share <= max_repeats + 1e-9

    # the last coarse k that is even enough, and the last coarse k that still repeats too much
    last_even = max([k for k in lo if even(k)], default=0)
    last_over = max([k for k in lo if not spare(k)], default=None)
    fine = list(range(last_even, min(STEPS, last_even + STEPS // FANOUT) + 1))
    if last_over is not None:
        fine += range(last_over, min(STEPS, last_over + STEPS // FANOUT) + 1)
    ok |= _at(totals, total, sorted(set(fine)))
    k = max([k for k in fine if even(k)], default=0)
    if not spare(k):
        k = min([j for j in sorted(ok) if j >= k and spare(j)], default=STEPS)
    return k


def plan_of(rows: DataFrame, budget: int | None, entropy: float, max_repeats: float) -> tuple[DataFrame, int, int]:
    """``src_of, full, rest`` of each source with tokens, how many there are, and the rows they have.

    full: whole passes over the source; rest: tokens of its last, partial one. Budgets are whole numbers
    by the largest remainder (ties: the smaller name), and sum to ``budget``.
    """
    totals = written(rows.groupBy("src").agg(F.sum("tok").alias("t_src"), F.count("*").alias("n_src")).where("t_src > 0"), "totals")
    whole = totals.agg(F.sum("t_src").alias("t"), F.sum("n_src").alias("n"), F.count("*").alias("s")).first()
    total, n_rows, n_sources = whole.t or 0, whole.n or 0, whole.s
    budget = total if budget is None else budget
    k = exponent(totals, total, budget / total, entropy, max_repeats) if total else STEPS
    weighed = totals.select("src", "t_src", weight(k, F.col("t_src"), total).cast("decimal(19,0)").alias("w"))
    z = int(weighed.agg(F.sum("w").alias("z")).first().z or 1)
    share, all_of = F.lit(budget).cast("decimal(19,0)") * F.col("w"), F.lit(z).cast("decimal(38,0)")
    floors = weighed.select("src", "t_src", F.expr(f"(cast({budget} as decimal(19,0)) * w) div cast({z} as decimal(38,0))").alias("b"), (share % all_of).cast("decimal(38,0)").alias("r"), F.lit(1).cast("long").alias("one"))
    floors = written(floors, "budgets")
    short = budget - int(floors.agg(F.sum("b").alias("b")).first().b or 0) if total else 0
    n = buckets_for(n_sources)
    floors = floors.withColumn("bucket", F.floor((all_of - F.col("r")).cast("double") / float(z) * n).cast("long"))
    ranked = running(floors, [], "bucket", [F.col("r").desc(), F.col("src")], {"rank": "one"})
    b = F.col("b") + (F.col("rank") <= short).cast("long")
    plan = ranked.select(F.col("src").alias("src_of"), b.alias("b"), "t_src").select("src_of", F.expr("b div t_src").alias("full"), (F.col("b") % F.col("t_src")).alias("rest"))
    return written(plan, "plan"), n_sources, n_rows


def _source(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS,
        seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", tokens: str | None = None) -> DataFrame:
    """Rows of ``docs``, each as often as it is drawn, plus ``mix_block`` (int, 0 first) and ``mix_rank`` (long, from 1).

    ``budget``: tokens in all; by default as many as ``docs`` has. ``tokens``: a column with token
    counts, else words of column text are counted. Columns named mix_block or mix_rank are replaced.
    Sources without a token are never drawn; rows without tokens in other sources cost nothing and come
    with every full block. A null source is a source of its own; rows with a null id hash by row. Ties of
    the seeded hash are broken by id, then by row. An empty table gives an empty result. Only row numbers
    are ranked; whole rows are shuffled once, to meet their ranks. At exponent 1 and a budget of all tokens
    every row comes once.
    """
    keep = [c for c in docs.columns if c.lower() not in ("mix_block", "mix_rank")]
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _source(source_col).alias("src"), F.col(id_col).cast("string").alias("id"),
        (F.col(tokens).cast("long") if tokens else n_tokens()).alias("tok"), F.monotonically_increasing_id().alias("rid"),
    )
    kept = written(kept, "rows")
    rows = kept.select("rid", "src", F.coalesce("id", F.concat(F.lit("row "), F.col("rid").cast("string"))).alias("id"), "tok")
    plan, _, n_rows = plan_of(rows, budget, entropy, max_repeats)
    drawn = rows.join(plan, F.col("src") == F.col("src_of")).select(
        "rid", "src", "id", "tok", "full", "rest",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))).alias("block"), F.lit(1).cast("long").alias("one"),
    )
    drawn = drawn.where("block < full OR rest > 0").withColumn("h", uniform(seed, F.col("block").cast("string"), F.col("id")))
    drawn = drawn.withColumn("b", range_of(F.col("h"), buckets_for(int(n_rows))))
    placed = running(drawn, ["src", "block"], "b", [F.col("h"), F.col("id"), F.col("rid")], {"upto": "tok", "rank": "one"})
    placed = placed.where("block < full OR upto <= rest").select(
        F.col("rid").alias("of"), F.col("block").cast("int").alias("mix_block"), F.col("rank").alias("mix_rank")
    )
    return kept.select("rid", "row").join(placed, F.col("rid") == F.col("of")).select("row.*", "mix_block", "mix_rank")


def draw(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS,
         seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Rows of ``docs``, each as often as mix() draws it, without ranks.

    The order within a block is cut at one key a source, so whole rows are compared with it where they
    are and never shuffled; ids, sources and counts are. Rows equal in every column are cut together:
    a partial block takes all of them or none. Rows with a null id hash by their columns. Otherwise as mix().
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    content = F.xxhash64(*cols).cast("string")
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("row "), content))
    rows = written(docs.select(_source(f"`{source_col}`").alias("src"), id_.alias("id"), content.alias("content"), n_tokens().alias("tok")), "keys")
    plan, n_sources, n_rows = plan_of(rows, budget, entropy, max_repeats)
    partial = rows.join(plan.where("rest > 0"), F.col("src") == F.col("src_of"))
    partial = partial.withColumn("h", uniform(seed, F.col("full").cast("string"), F.col("id"))).groupBy("src", "rest", "h", "id", "content").agg(F.sum("tok").alias("tok"))
    partial = partial.withColumn("b", range_of(F.col("h"), buckets_for(int(n_rows))))
    placed = running(partial, ["src"], "b", [F.col("h"), F.col("id"), F.col("content")], {"upto": "tok"})
    cuts = placed.where("upto <= rest").groupBy("src").agg(F.max(F.struct("h", "id", "content")).alias("cut"))
    cuts = plan.join(cuts, F.col("src_of") == F.col("src"), "left").select("src_of", "full", "cut")
    if n_sources <= FEW_SOURCES:
        cuts = F.broadcast(cuts)
    key = F.struct(uniform(seed, F.col("full").cast("string"), F.col("id")).alias("h"), F.col("id").alias("id"), F.col("content").alias("content"))
    slim = docs.select(F.struct(*cols).alias("row"), _source(f"`{source_col}`").alias("src"), id_.alias("id"), content.alias("content"))
    out = slim.join(cuts, F.col("src") == F.col("src_of"))
    times = F.col("full").cast("int") + F.coalesce(key <= F.col("cut"), F.lit(False)).cast("int")
    return out.withColumn("times", times).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def mix_table(docs: DataFrame) -> DataFrame:
    """The rows that the mixing query returns: ids, sources and counts instead of texts."""
    return mix(docs.select("doc_id", "source", n_tokens().alias("n_tokens")), tokens="n_tokens")
