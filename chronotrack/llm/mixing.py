"""Source mixing: token weights raked to marginals by iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronotrack.llm._store import write_table

SWEEPS = 12
#: Sweeps between written tables.
CUT = 4
#: Up to this many cells are raked in one task, where windows need no shuffle (as many rows as a broadcast of them takes).
FEW_CELLS = 200_000
#: Exponent that flattens each observed marginal into its default target.
FLATTEN = 0.5
#: Share of all tokens that the mixture asks for.
BUDGET = 0.3
DIMENSIONS = ("source", "lang", "topic")
#: Fixed patterns of the default topics, in order of precedence.
TOPICS = (("legal", r"(?i)licen[sc]e|copyright|all rights reserved"), ("contact", r"@[A-Za-z0-9]|https?://|\d{3}[-. ]\d{4}"), ("data", r"[|{}<>=]"), ("shout", r"!!|\*\*\*"))


#: The white space of tokens, as characters.
SPACE = " \t\n\x0b\x0c\r"


def default_topic(text: Column) -> Column:
    """The first of TOPICS whose pattern the text holds, by searches for fixed strings where these are enough."""
    text = F.coalesce(text, F.lit(""))
    lower = F.lower(text)
    any_of = lambda where, *words: functools.reduce(operator.or_, (F.contains(where, F.lit(w)) for w in words))
    holds = {
        "legal": any_of(lower, "license", "licence", "copyright", "all rights reserved"),
        "contact": any_of(text, "http://", "https://") | (F.contains(text, F.lit("@")) & text.rlike("@[A-Za-z0-9]")) | text.rlike(r"\d{3}[-. ]\d{4}"),
        "data": any_of(text, *"|{}<>="),
        "shout": any_of(text, "!!", "***"),
    }
    found = F.lit("prose")
    for name, _ in reversed(TOPICS):
        found = F.when(holds[name], name).otherwise(found)
    return found


def token_count(text: Column) -> Column:
    """Runs of other characters than white space, each replaced by one character with what follows it, so no array of them is made."""
    text = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from the MD5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def rake(cells: DataFrame, dims: tuple[str, ...], targets: dict[str, dict[str, float]] | None, budget: float, sweeps: int) -> DataFrame:
    """``cells`` (dims, tokens) with weight: tokens asked of each cell.

    Starts from the cells' own tokens. Each sweep scales every cell to each marginal in turn, then holds no cell above
    the tokens that it has. A target not given is the observed marginal to the power FLATTEN, made to sum to 1; values
    missing in a given target get 0. Only cells move: their number is that of the distinct combinations. FEW_CELLS or
    fewer are raked in one partition, which already satisfies every window; more by shuffles, with the same weights.
    """
    cells = write_table(cells, "cells")
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = float(total or 0)
    held_together = (lambda df: df.coalesce(1)) if n <= FEW_CELLS else lambda df: df
    cells = held_together(cells)
    free = [d for d in dims if not (targets and d in targets)]
    marginal = {d: cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(FLATTEN)).alias("m")) for d in free}
    sizes = {}
    if free:
        each = functools.reduce(DataFrame.union, (marginal[d].agg(F.lit(d).alias("d"), F.sum("m").alias("m")) for d in free))
        sizes = {r.d: r.m or 1.0 for r in each.collect()}
    for d in dims:
        if d not in free:
            share = F.lit(0.0)
            for value, x in sorted(targets[d].items()):
                share = F.when(F.col(d) == value, F.lit(float(x))).otherwise(share)
            cells = cells.withColumn(f"aim_{d}", share)
        else:
            cells = cells.join(marginal[d].select(d, (F.col("m") / F.lit(sizes[d])).alias(f"aim_{d}")), d)
    now = cells.withColumn("weight", F.col("tokens").cast("double") * budget)
    for sweep in range(1, sweeps + 1):
        for d in dims:
            held = F.sum("weight").over(W.partitionBy(d))
            now = now.withColumn("weight", F.when(held > 0, F.col("weight") * (F.col(f"aim_{d}") * F.lit(total * budget) / held)).otherwise(F.lit(0.0)))
        now = now.withColumn("weight", F.least(F.col("weight"), F.col("tokens").cast("double")))
        if sweep % CUT == 0 or sweep == sweeps:
            now = held_together(write_table(now, "cells"))
    return now


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
    budget: float = BUDGET,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """``docs`` with n_tokens, topic, keep_probability and sampled.

    Columns source and lang name the first two dimensions (null, or missing: `none`); ``topic`` is an expression over
    ``docs`` (by default classes of text by fixed patterns). A document's probability is its cell's raked weight over its
    cell's tokens; it is sampled where a hash of its id, uniform in [0, 1), is below that, so repeated rows share one
    decision. A text without tokens (null, empty) has probability 0 weight in its cell but the cell's probability; a cell
    without tokens has probability 0. Empty input: no rows. Columns of ``docs`` with the names added are replaced.
    """
    docs = docs.drop("n_tokens", "keep_probability", "sampled", *([] if topic is not None else ["topic"]))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")) if c in docs.columns else F.lit("none")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({"n_tokens": token_count(text), "__source": own("source"), "__lang": own("lang"), "__topic": F.coalesce(topic, F.lit("none")) if topic is not None else default_topic(text)})
    cells = keyed.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("n_tokens").alias("tokens"))
    raked = rake(cells, DIMENSIONS, targets, budget, sweeps)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(F.lit(0.0))
    raked = raked.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), p.alias("keep_probability"))
    n = raked.count()
    # Rows meet their cell by broadcast while the cells are few; beyond that, by a shuffle join that AQE may split.
    found = keyed.join(F.broadcast(raked) if n <= FEW_CELLS else raked, ["__source", "__lang", "__topic"])
    found = found.drop("topic").withColumn("topic", F.col("__topic")).withColumn("sampled", uniform(F.col(id_col)) < F.col("keep_probability"))
    return found.drop("__source", "__lang", "__topic")


def mixing_sql(budget: float = BUDGET, sweeps: int = SWEEPS, table: str = "documents") -> str:
    """The same in DuckDB SQL: doc_id, n_tokens, topic, keep_probability (9 decimals), sampled."""
    cases = " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for n, p in TOPICS)
    sql = [
        f"""d as (select doc_id, coalesce(source, 'none') as source, coalesce(lang, 'none') as lang, case {cases} else 'prose' end as topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from {table})""",
        "c as (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all)",
        "t as (select sum(tokens) as total from c)",
    ]
    for d in DIMENSIONS:
        sql.append(f"m_{d} as (select {d}, pow(sum(tokens), {FLATTEN}) as m from c group by all)")
    aims = ", ".join(f"(select m / (select sum(m) from m_{d}) from m_{d} where m_{d}.{d} = c.{d}) as aim_{d}" for d in DIMENSIONS)
    sql.append(f"w0 as materialized (select c.*, total, {aims}, tokens * {budget} as weight from c, t)")
    last = "w0"
    for s in range(sweeps):
        for d in DIMENSIONS:
            new = f"w{s}_{d}"
            sql.append(
                f"{new} as materialized (select * replace (case when sum(weight) over (partition by {d}) > 0 then weight * (aim_{d} * (total * {budget}) / sum(weight) over (partition by {d})) else 0.0 end as weight) from {last})"
            )
            last = new
        sql.append(f"w{s}_cap as materialized (select * replace (least(weight, tokens) as weight) from {last})")
        last = f"w{s}_cap"
    return (
        "with "
        + ",\n".join(sql)
        + f"""
select doc_id, n_tokens, topic, round(p, 9) as keep_probability, cast('0x' || substr(md5(doc_id::varchar), 1, 8) as bigint) / 4294967296.0 < p as sampled
from (select d.doc_id, d.n_tokens, d.topic, case when tokens > 0 then least(1.0, weight / tokens) else 0.0 end as p from d join {last} using (source, lang, topic))"""
    )
