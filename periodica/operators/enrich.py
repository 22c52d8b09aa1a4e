"""Friendly names, families and flags for model codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.numbers import percent
from periodica.functions.rules import Rule, first_match, lookup
from periodica.functions.text import normalize_text, strip
from periodica.presets import (
    BRAND_A,
    CORE_FAMILIES_A,
    IMPORT_PREFIXES,
    PREMIUM_CODE_SUFFIX,
    PREMIUM_NAME_TOKEN,
)
from periodica.sources.glossary import CODE, NAME
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, desc

DISPLAY = "nome_exibicao"

# The two categories of the premium report.
PREMIUM = "CVOs"
IMPORTS = "Importacao independente"


def enrich_models(
    frame: DataFrame, glossary: DataFrame | None, source: str = DEFAULT_SPEC.model
) -> DataFrame:
    """Attach code, friendly name and display name; a frame without ``source`` passes through.

    The glossary side carries no broadcast hint: the optimizer broadcasts it while its measured
    size is small and shuffles otherwise. Apply this to aggregated rows, where codes are unique.
    """
    if source not in frame.columns:
        return frame
    # Names the frame already carries are replaced.
    frame = frame.drop(*(c for c in (CODE, NAME, DISPLAY) if c != source))
    if glossary is None:
        named = frame.withColumns({CODE: F.col(source), NAME: F.lit("")})
    else:
        entries = glossary.select(F.col(CODE).alias("_codigo"), F.col(NAME).alias("_nome"))
        joined = frame.join(entries, F.col(source) == F.col("_codigo"), "left")
        named = joined.select(
            *frame.columns,
            F.coalesce("_codigo", source).alias(CODE),
            F.coalesce("_nome", F.lit("")).alias(NAME),
        )
    has_name = strip(F.col(NAME)) != ""
    display = F.when(has_name, F.concat(F.col(CODE), F.lit(" | "), F.col(NAME))).otherwise(F.col(CODE))
    return named.withColumn(DISPLAY, display)


def codes_by_name(glossary: DataFrame, name: str) -> DataFrame:
    """Codes whose friendly name equals ``name``, ignoring case and outer white space."""
    wanted = F.lower(F.lit(name.strip()))
    codes = glossary.filter(F.lower(strip(F.col(NAME))) == wanted).select(CODE)
    return codes.filter(strip(F.col(CODE)) != "").distinct().orderBy(*asc(CODE))


def _upper(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def with_family(
    frame: DataFrame,
    rules: Sequence[Rule] = BRAND_A.families,
    default: str = BRAND_A.default_family,
    code: str = CODE,
    name: str = NAME,
) -> DataFrame:
    """Family of each row: first rule that hits the code without spaces, or code and name."""
    # The two texts are columns of their own, so that they are built once for all tokens.
    texts = frame.withColumns({"_codigo_plano": F.replace(_upper(F.col(code)), F.lit(" "), F.lit(""))})
    texts = texts.withColumns({"_texto": F.concat(F.col("_codigo_plano"), F.lit(" "), _upper(F.col(name)))})
    family = first_match(rules, F.col("_texto"), F.col("_codigo_plano"), default)
    return texts.withColumn("family", family).drop("_texto", "_codigo_plano")


def is_premium(code: Column, name: Column) -> Column:
    plain = F.replace(_upper(code), F.lit(" "), F.lit(""))
    return _upper(name).contains(PREMIUM_NAME_TOKEN) | plain.endswith(PREMIUM_CODE_SUFFIX)


def is_independent_import(code: Column) -> Column:
    hit = F.lit(False)
    for prefix in IMPORT_PREFIXES:
        hit = hit | _upper(code).startswith(prefix)
    return hit


def labelled_snapshot(
    snapshot: DataFrame,
    glossary: DataFrame | None,
    rules: Sequence[Rule] = BRAND_A.families,
    default: str = BRAND_A.default_family,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Models at a period with names, family, premium and import flags."""
    named = with_family(enrich_models(snapshot, glossary, spec.model), rules, default)
    return named.withColumns(
        {
            "is_import_indep": is_independent_import(F.col(CODE)),
            "is_cvo": is_premium(F.col(CODE), F.col(NAME)),
        }
    )


def classify_by_text(
    model: Column, rules: Sequence[Rule], default: str
) -> Column:
    """Family from the normalised code alone."""
    text = normalize_text(model)
    return first_match(rules, text, text, default)


def friendly_name(model: Column, names: Mapping[str, str]) -> Column:
    """Name of the normalised code, otherwise the raw value."""
    return lookup(normalize_text(model), names, model)


def family_mix(
    labelled: DataFrame, core: Sequence[str] = CORE_FAMILIES_A, units: str = "total"
) -> DataFrame:
    """Units and percentage per family; ``lider`` marks the largest of the core families."""
    # One row per family: at most one more than there are rules.
    families = labelled.groupBy("family").agg(F.sum(units).alias(units))
    every = Window.partitionBy(F.lit(0))
    in_core = F.col("family").isin(list(core)) if core else F.lit(False)
    rank = F.row_number().over(Window.partitionBy(in_core).orderBy(*desc(units), *asc("family")))
    return families.select(
        "family",
        units,
        percent(F.col(units), F.sum(units).over(every)).alias("share_pct"),
        (in_core & (rank == 1)).alias("lider"),
    ).orderBy(*desc(units), *asc("family"))


def premium_pyramid(labelled: DataFrame, units: str = "total") -> DataFrame:
    """Units and percentage of the premium and of the imported stock; the two overlap."""
    amount, zero = F.col(units), F.lit(0).cast("bigint")
    sums = labelled.agg(
        F.coalesce(F.sum(amount), zero).alias("_todos"),
        F.coalesce(F.sum(F.when(F.col("is_cvo"), amount)), zero).alias("_cvo"),
        F.coalesce(F.sum(F.when(F.col("is_import_indep"), amount)), zero).alias("_importado"),
    )

    def entry(label: str, column: str) -> Column:
        share = F.coalesce(percent(F.col(column), F.col("_todos")), F.lit(0.0))
        return F.struct(F.lit(label).alias("categoria"), F.col(column).alias(units), share.alias("share_pct"))

    both = F.array(entry(PREMIUM, "_cvo"), entry(IMPORTS, "_importado"))
    return sums.select(F.inline(both)).orderBy(*asc("categoria"))


def premium_top(labelled: DataFrame, limit: int = 12, units: str = "total") -> DataFrame:
    """Largest models of each category."""
    columns = [CODE, NAME, units]

    def largest(flag: str, label: str) -> DataFrame:
        rows = labelled.filter(F.col(flag)).select(F.lit(label).alias("categoria"), *columns)
        return rows.orderBy(*desc(units), *asc(CODE)).limit(limit)

    both = largest("is_cvo", PREMIUM).unionByName(largest("is_import_indep", IMPORTS))
    return both.orderBy(*asc("categoria"), *desc(units), *asc(CODE))


def base_builder_top(
    ranking: DataFrame,
    glossary: DataFrame | None,
    limit: int = 15,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """First models of a base-builder ranking with their names.

    The cut comes before the names: the glossary meets at most ``limit`` rows.
    """
    order = desc("vendas_proxy_total") + asc(spec.model)
    top = ranking.orderBy(*order).limit(limit)
    return enrich_models(top, glossary, spec.model).orderBy(*order)
