"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Token-weighted relative entropy to the natural rate 1, sum of size * (r log r - r + 1), is minimised under token
constraints on one or more margins (source, language, ...). The dual is convex, and its solution tilts each document's
rate exponentially: r = exp(sum of its categories' multipliers). Newton's method solves it for all margins at once:
every round aggregates the gradient and the Hessian over cells of documents with the same categories. Rates become
copies by a threshold on a hash per category of the first margin, so that the words taken come within one document of
the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import word_count, written


def capped_targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources. ``sources``: source, tokens. Adds weight and target.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all tokens; a target stops
    at ``most`` times its source's tokens and the excess is shared anew by weight, until none is above. That fixed point
    is the level at which the sum of least(cap, weight * level) is the sum to share; sources by cap / weight give it.
    One row per source goes through these windows, never a document. An empty source has target 0.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("_rank"))
    ranked = sources.select("source", "tokens", F.row_number().over(by_name).alias("_rank"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", pick).withColumn("_cap", F.col("tokens") * F.lit(float(most)))
    total = F.sum("tokens").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (total - before) / after)
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    # Once sources stop being capped the level stays above what later sources would give, so the greatest that fits holds.
    found = level.withColumn("_found", F.max(fits).over(everything.partitionBy(F.lit(1))))
    return found.select("source", "tokens", "weight", F.least(F.col("_cap"), F.coalesce(F.col("weight") * F.col("_found"), F.col("_cap"))).alias("target"))


def _categories(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every cell with each of its categories: _cell, tokens, m (the margin's number), k (its category; null has a name of its own)."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    each = F.array(*[F.struct(F.lit(i).alias("m"), name(c).alias("k")) for i, c in enumerate(columns)])
    return cells.select("_cell", "tokens", F.explode(each).alias("c")).select("_cell", "tokens", "c.m", "c.k")


def _tilts(member: DataFrame, dual: DataFrame) -> DataFrame:
    """Tokens of every cell, tilted by the multipliers of its categories: one aggregation."""
    met = member.join(dual.select("m", "k", "x"), ["m", "k"])
    return met.groupBy("_cell").agg((F.first("tokens") * F.exp(F.sum("x"))).alias("tilted"))


def _newton_step(member: DataFrame, tilts: DataFrame, dual: DataFrame, margins: int, inner: int, within: float) -> DataFrame:
    """``dual`` (m, k, x, target, have) with ``d``: the solution of Hessian * d = target - have.

    One margin has a diagonal Hessian. With several it is solved by conjugate gradients, preconditioned by the diagonal:
    each product with the Hessian is one aggregation over cells and one over categories, and no matrix is ever built.
    """
    start = dual.withColumn("r", F.col("target") - F.col("have")).withColumn("z", F.col("r") / F.col("have"))
    if margins == 1:
        return start.withColumn("d", F.col("z"))
    now = written(start.withColumns({"d": F.lit(0.0), "p": F.col("z")}), "mix-cg")
    rz = first = now.agg(F.sum(F.col("r") * F.col("z"))).first()[0] or 0.0
    weighed = member.drop("tokens").join(tilts, "_cell")
    for _ in range(inner):
        if rz <= within * within * first or rz <= 0:
            break
        ahead = weighed.join(now.select("m", "k", "p"), ["m", "k"]).groupBy("_cell").agg((F.first("tilted") * F.sum("p")).alias("v"))
        product = member.join(ahead, "_cell").groupBy("m", "k").agg(F.sum("v").alias("q"))
        now = written(now.join(product, ["m", "k"]), "mix-cg")
        pq = now.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if pq <= 0:
            break
        far = rz / pq
        now = now.withColumns({"d": F.col("d") + far * F.col("p"), "r": F.col("r") - far * F.col("q")}).drop("q").withColumn("z", F.col("r") / F.col("have"))
        before, rz = rz, now.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
        now = now.withColumn("p", F.col("z") + rz / before * F.col("p"))
    return now


def entropy_balance(cells: DataFrame, margins: Sequence[tuple[str, DataFrame]], most_rounds: int = 60, tolerance: float = 1e-13, inner: int = 200, within: float = 1e-3) -> DataFrame:
    """``cells``: a row per combination of categories, with tokens. ``margins``: (column, its targets: column, target).

    Returns the cells with ``rate``. Each round of Newton's method on the dual is one aggregation of the gradient and the
    Hessian over cells, a step by ``_newton_step``, cut so that no multiplier moves by more than 1, and ends when every
    category's tokens are within ``tolerance`` of its target, or when they no longer come nearer. Multipliers stay a
    table; only norms reach the driver. A category with no tokens or target 0 gets rate 0. Targets of later margins are
    scaled to the sum of the first's, since all margins count the same tokens.
    """
    columns = [c for c, _ in margins]
    cells = written(cells.withColumn("_cell", F.monotonically_increasing_id()), "mix-cells")
    member = _categories(cells, columns)
    wanted = None
    for i, (column, targets) in enumerate(margins):
        name = F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))
        one = targets.select(F.lit(i).alias("m"), name.alias("k"), F.col("target").cast("double").alias("target")).where("target > 0")
        wanted = one if wanted is None else wanted.union(one)
    # Cells of a category without a target have rate 0 and leave the dual.
    live = member.join(wanted, ["m", "k"]).where("tokens > 0").groupBy("_cell").agg(F.count("*").alias("_of")).where(F.col("_of") == len(margins)).select("_cell")
    member = written(member.join(live, "_cell"), "mix-members")
    dual = member.select("m", "k").distinct().join(wanted, ["m", "k"])
    if len(margins) > 1:
        totals = dual.groupBy(F.col("m").alias("_m")).agg(F.sum("target").alias("_sum"))
        scale = totals.crossJoin(totals.where("_m = 0").select(F.col("_sum").alias("_first")))  # a row per margin
        dual = dual.join(F.broadcast(scale), F.col("m") == F.col("_m")).withColumn("target", F.col("target") * F.col("_first") / F.col("_sum"))
    dual = written(dual.select("m", "k", "target", F.lit(0.0).alias("x")), "mix-dual")
    last = float("inf")
    for _ in range(most_rounds):
        tilts = _tilts(member, dual)
        if len(margins) > 1:
            tilts = written(tilts, "mix-tilts")
        have = member.join(tilts, "_cell").groupBy("m", "k").agg(F.sum("tilted").alias("have"))
        at = written(dual.join(have, ["m", "k"]), "mix-gradient")
        off = at.agg(F.max(F.abs(F.col("have") / F.col("target") - 1))).first()[0]
        if off is None or off <= tolerance or (last < 1e-9 and off >= last):
            break
        last = off
        step = _newton_step(member, tilts, at, len(margins), inner, within)
        far = step.agg(F.max(F.abs("d"))).first()[0]
        dual = written(step.select("m", "k", "target", (F.col("x") + F.col("d") / max(1.0, far)).alias("x")), "mix-dual")
    tilted = member.join(dual.select("m", "k", "x"), ["m", "k"]).groupBy("_cell").agg(F.exp(F.sum("x")).alias("rate"))
    return cells.join(tilted, "_cell", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0))).drop("_cell")


def round_to_copies(rated: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 17, in_bin: int = 20_000) -> DataFrame:
    """``rated``: id, source, size, rate. ``targets``: source, tokens, target. Adds copies.

    Each document gets the whole part of its rate; the fraction makes it draw u / fraction from a hash of its id, and
    draws below one threshold per source add a copy. The threshold is the size-weighted quantile that meets the target:
    found in a histogram of draws, then, within the one bin where it falls, by a running sum. Bins grow in number with
    the largest source, so a bin holds about ``in_bin`` rows at any size, and no window spans a source.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    whole = F.floor(F.col("rate") + F.lit(1e-9))
    most = rated.groupBy("source").agg(F.count("*").alias("_rows"), F.sum(whole * F.col("size")).alias("_sure"))
    most = most.select(F.col("source").alias("_source"), "_rows", "_sure", F.greatest(F.lit(16), F.ceil(F.col("_rows") / F.lit(in_bin))).alias("_bins"))
    plan = written(targets.join(most, F.col("source").eqNullSafe(F.col("_source"))).select("_source", "_bins", (F.col("target") - F.col("_sure")).alias("_need")), "mix-plan")
    drawn = rated.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    fraction = F.col("rate") - whole
    drawn = drawn.withColumn("_whole", whole.cast("int")).withColumn("_draw", F.when(fraction > 1e-9, u / fraction))
    drawn = drawn.withColumn("_bin", F.when(F.col("_draw").isNotNull(), F.least(F.floor(F.col("_draw") * F.col("_bins")), F.col("_bins") * 4)))
    bins = drawn.where("_bin IS NOT NULL").groupBy("_source", "_bin").agg(F.sum("size").alias("_mass"), F.first("_need").alias("_need"))
    upto = F.sum("_mass").over(Window.partitionBy("_source").orderBy("_bin"))
    edge = bins.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_need")).groupBy("_source").agg(F.min(F.struct("_bin", (F.col("_need") - F.col("_upto") + F.col("_mass")).alias("_left"))).alias("_e"))
    edge = edge.select(F.col("_source").alias("_edge_of"), F.col("_e._bin").alias("_edge"), F.col("_e._left").alias("_left"))
    edge = written(edge, "mix-edge")
    drawn = drawn.join(edge, F.col("_source").eqNullSafe(F.col("_edge_of")), "left")
    inside = F.col("_bin") == F.col("_edge")
    ordered = Window.partitionBy("_source").orderBy("_draw", id_col)
    at_edge = drawn.where(inside).withColumn("_sum", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    at_edge = at_edge.withColumn("_extra", (F.col("_sum") - F.col("size") / 2.0 <= F.col("_left")).cast("int"))
    rest = drawn.where(F.coalesce(~inside, F.lit(True))).withColumn("_sum", F.lit(None).cast("long"))
    rest = rest.withColumn("_extra", F.when(F.col("_bin").isNotNull() & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge"))), 1).otherwise(0))
    copies = F.when(F.col("rate") > 0, F.col("_whole") + F.col("_extra")).otherwise(0).cast("int")
    return rest.unionByName(at_edge).withColumn("copies", copies).select(*rated.columns, "copies")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Mix all of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken, a row per input row.

    Size is the number of words; a null text has none and takes none. A null source is a source, the last in order.
    An empty table gives an empty one. Rows that repeat count each for itself but draw alike, by id. Other columns of
    ``docs`` are not looked at, whatever their names.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("tokens"))
    targets = written(capped_targets(sources, weights, share, most), "mix-targets")
    rates = entropy_balance(targets.select("source", "tokens"), [("source", targets.select("source", "target"))])
    rates = rates.select(F.col("source").alias("_of"), "rate").join(targets.select(F.col("source").alias("_same"), F.col("tokens").alias("source_size"), "target"), F.col("_of").eqNullSafe(F.col("_same"))).drop("_same")
    rates = written(rates, "mix-rates")
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    rated = rated.withColumn("rate", F.least(F.col("rate"), F.lit(float(most))))
    out = round_to_copies(rated, targets, "doc_id")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies.

    Rows of one id are told apart by source and size; rows that agree in all three are taken alike, as often as the
    mix takes them on the whole, rounded. Null texts have no words and are taken as their source's rate says.
    """
    copies = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    copies = copies.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_size")).agg(F.round(F.avg("copies")).cast("int").alias("_copies")).where("_copies > 0")
    out = docs.join(copies, F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_of")) & (word_count(F.col(text_col)) == F.col("_size")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
