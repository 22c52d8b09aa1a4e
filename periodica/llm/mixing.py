"""Mixing sources to target weights by iterative proportional fitting, native DataFrame operations only.

Every document belongs to a cell (source, language, topic) and weighs its tokens. The cells' token sums
are raked: their weights are scaled to the target shares of one margin after the other until all margins
agree. The ratio of fitted to actual tokens of a cell is the rate at which its documents are wanted; rates,
scaled so that the sample holds the stated share of the tokens (``KEPT``) and capped at one, are the inclusion probabilities,
and a document is kept where the hash of its id and text falls below it. So the sample's tokens follow the targets, a cell
that is too rare for its target gives all it has, and no document is repeated.

Documents are never shuffled by cell while the cells are few enough to broadcast: only cells are, one row for each combination
that occurs. Their texts are read twice where the result holds them (``mix``), once where it does not (``mix_without_texts``). A source that holds a third of all rows is summed before the shuffle.

Targets are given for each margin as a frame (value, share), or follow from ``temperatures``: a margin's shares are its
token shares to that power, so 1 leaves them and 0 makes them equal.

Defined results: a null source, language or text is a value of its own ('' for a text); a document without
words weighs nothing and is kept with its cell's probability; a value without a target is left out (rate 0) and one that the
corpus lacks is ignored; equal rows share one fate; an empty table gives no rows. Columns of the
documents come back unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, text_of

MARGINS = ("source", "lang", "topic")
#: Passes over the margins at most, and how far a margin may be off, as a part of itself.
SWEEPS = 12
TOLERANCE = 1e-4
#: Share of the tokens that the sample holds, and steps at most to find its scale.
KEPT = 0.5
STEPS = 200
NULL_VALUE = "\u0000none"


def token_count() -> F.Column:
    """Words of the text: runs of characters between white space."""
    bare = F.trim(F.regexp_replace(text_of(), r"[ \t-\r]+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def topic() -> F.Column:
    """A document's kind, read from its whole text: legal notice, table, markup, long prose, prose or fragment."""
    text = text_of()
    return (
        F.when(F.lower(text).rlike("licen[cs]e|copyright|all rights reserved"), "legal")
        .when(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= F.lit(8), "table")
        .when(F.contains(text, F.lit("</")) | F.contains(text, F.lit("{")), "markup")
        .when(F.length(text) >= 8000, "long prose")
        .when(F.length(text) >= 400, "prose")
        .otherwise("fragment")
    )


def _with_cells(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in the struct ``row``, the margins and the tokens."""
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit(NULL_VALUE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NULL_VALUE)).alias("lang"),
        topic().alias("topic"),
        token_count().alias("tokens"),
        F.xxhash64(F.lit("mixing"), "doc_id", text_of()).alias("draw"),
    )


def _sum_by(cells: DataFrame, margin: str, value: str) -> DataFrame:
    return cells.groupBy(margin).agg(F.sum(value).alias("total"))


def targets_by_temperature(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share): token shares of the margin to the given power, summing to one."""
    raised = _sum_by(cells, margin, "tokens").where("total > 0").select(margin, F.pow("total", F.lit(power)).alias("raised"))
    whole = raised.agg(F.sum("raised")).scalar()
    return raised.select(F.col(margin).alias("value"), (F.col("raised") / whole).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(margins, tokens, fitted): cells with ``fitted`` tokens whose shares meet ``targets``, or come as near as they can.

    One sweep scales to each margin in turn. The fit ends after ``sweeps`` or when no share of any margin is
    off by over ``tolerance`` of itself before its scaling.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        off = F.lit(0.0)
        for margin in MARGINS:
            now = _sum_by(fitted, margin, "fitted")
            wanted = targets[margin].select(F.col("value").alias(margin), "share")
            scale = now.join(wanted, margin, "left").select(
                margin,
                F.when(F.col("total") > 0, F.coalesce("share", F.lit(0.0)) * F.lit(float(total)) / F.col("total"))
                .otherwise(0.0)
                .alias("scale"),
            )
            fitted = fitted.join(scale, margin).withColumn("fitted", F.col("fitted") * F.col("scale"))
            off = F.greatest(off, F.when(F.col("fitted") > 0, F.abs(F.col("scale") - 1)).otherwise(0.0))
            fitted = fitted.withColumn("off", off).drop("scale")
            off = F.col("off")
        fitted = cut(fitted.select(*MARGINS, "tokens", "n", "fitted", "off"), "raked")
        worst = fitted.agg(F.max("off")).first()[0]
        fitted = fitted.drop("off")
        if worst is None or worst <= tolerance:
            break
    return fitted


def inclusion(raked: DataFrame, kept: float = KEPT) -> DataFrame:
    """(margins, probability): rates scaled so that ``kept`` of the tokens that have a target are drawn in the mean.

    The scale solves sum(tokens * min(1, scale * rate)) = kept * sum(tokens): a cell whose scaled rate passes one gives all
    its documents, short of its target by what it lacks, and the others make up for its tokens in proportion to their rates.
    """
    if not 0 < kept <= 1:
        raise ValueError("the kept share must be above 0 and at most 1")
    rate = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(0.0)
    rated = raked.withColumn("rate", rate)
    wanted = rated.where("rate > 0")
    # The sum is concave in the scale and made of straight pieces: Newton steps from below reach the root from the left.
    total, scale = kept * (wanted.agg(F.sum("tokens")).first()[0] or 0), 0.0
    for _ in range(STEPS):
        whole = F.col("rate") * F.lit(scale) >= 1
        taken, free = wanted.agg(
            F.sum(F.when(whole, F.col("tokens")).otherwise(F.col("fitted") * F.lit(scale))), F.sum(F.when(~whole, F.col("fitted")))
        ).first()
        if not free or total - taken <= 1e-9 * total:
            break
        scale += (total - taken) / free
    else:
        raise RuntimeError("the scale of the rates did not settle")
    chance = F.least(F.lit(1.0), F.col("rate") * F.lit(scale))
    return rated.select(*MARGINS, F.when(F.col("tokens") == 0, 1.0).otherwise(chance).alias("probability"))


def mix(
    docs: DataFrame,
    temperatures: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    kept: float = KEPT,
) -> DataFrame:
    """``row`` (the document), margins, tokens and probability of the documents drawn. Texts are read twice: to count, to return them."""
    return _drawn(_with_cells(docs), temperatures, targets, kept)


def mix_without_texts(
    docs: DataFrame,
    temperatures: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    kept: float = KEPT,
) -> DataFrame:
    """As ``mix``, but ``row`` has no text: what the fit and the draw need is written once, and texts are read once."""
    measured = _with_cells(docs).withColumn("row", F.col("row").dropFields("text"))
    return _drawn(cut(measured, "measured"), temperatures, targets, kept)


def _drawn(rows: DataFrame, temperatures: dict[str, float] | None, targets: dict[str, DataFrame] | None, kept: float) -> DataFrame:
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.9} | (temperatures or {})
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "cells")
    goals = {m: (targets or {}).get(m) or targets_by_temperature(cells, m, powers[m]) for m in MARGINS}
    goals = {m: cut(g, "goals") for m, g in goals.items()}
    chances = cut(inclusion(rake(cells, goals), kept), "chances")
    # 53 bits of the hash, as a number in [0, 1).
    drawn = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    return rows.join(chances, list(MARGINS)).where(drawn < F.col("probability")).drop("draw")
