"""Operator 9, mixing sources to target weights: hierarchical budgeting over domain, language and source.

A token budget is passed down a tree.  At each node it is divided among the children by their weights; a
child that cannot use its share (its capacity is its tokens times the epochs allowed) hands the shortage to
its siblings, and only what no sibling can take goes back to the level above.  With capacities summed from
the leaves (over children of positive weight), that is water filling at each node: ``min(capacity, level * weight)`` with the level that spends
the node's budget.  A leaf then takes whole epochs and, of the next epoch, the prefix of its documents, in
that epoch's seeded order, whose tokens end within what is left.

Only DataFrame functions are used.  The tree has one row per leaf; document rows are pre-aggregated to it.
The prefix is found in two steps, so that a hot leaf is never ordered in one task: documents fall into hash
buckets, bucket sums tell which bucket the budget ends in, and only that bucket is ordered.

Defined results: null domain, language or source is a leaf value of its own; a null or empty text has no
tokens and comes with the prefix it falls in; weights of 0 give no budget unless nothing else can take it
(then still none); a leaf missing from the weights has weight 1; repeated rows count as documents of their
own and are ordered by their text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm._common import documents, materialize, numbered, unused

LEVELS = ("domain", "lang", "source")
#: Rows of a bucket, at most about: what one task orders.
BUCKET_ROWS = 20_000
#: Rows of the plan (one a leaf) or of the buckets, of about 100 bytes each, that may be broadcast.
BROADCAST_LEAVES = 100_000


def source_domain(source: Column) -> Column:
    """Domain of a source, where the table has none: by the number in its name, three domains."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1).try_cast("int")
    return F.concat(F.lit("domain"), F.coalesce(F.pmod(number, F.lit(3)), F.lit(0)).cast("string"))


def word_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Divide each parent's ``budget`` among its rows by ``weight``, none above ``capacity``: adds ``share``."""
    by = Window.partitionBy(*parent)
    # In the order of capacity per weight, the first k children are filled; the rest share what is left.
    order = by.orderBy((F.col("capacity") / F.col("weight")).asc(), *LEVELS)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    live = nodes.where("weight > 0 AND capacity > 0")
    live = live.withColumn("filled", F.sum("capacity").over(upto) - F.col("capacity"))
    live = live.withColumn("open_weight", F.sum("weight").over(by) - F.sum("weight").over(upto) + F.col("weight"))
    level = (F.col("budget") - F.col("filled")) / F.col("open_weight")
    # Levels fall from the first child that isn't filled on; if all are filled, each gets its capacity.
    level = F.max(F.when(level * F.col("weight") <= F.col("capacity"), level)).over(by)
    return live.withColumn("share", F.least("capacity", F.coalesce(level * F.col("weight"), F.col("capacity"))))


def budgets(leaves: DataFrame, weights: DataFrame | None, total: Column, max_epochs: int) -> DataFrame:
    """Leaf budgets.  ``leaves``: domain, lang, source, tokens, docs; ``weights``: level (1 to 3), domain, lang, source, weight."""

    def weighed(nodes: DataFrame, path: list[str]) -> DataFrame:
        if weights is None:
            return nodes.withColumn("weight", F.lit(1.0))
        given = weights.where(F.col("level") == len(path)).select(*[F.col(c).alias(f"w_{c}") for c in path], "weight")
        same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in path]
        return nodes.join(given, same, "left").select(*path, "capacity", F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))

    # From the leaves up: a node can use what its children of positive weight can.
    tree = {3: weighed(leaves.select(*LEVELS, (F.col("tokens") * max_epochs).cast("double").alias("capacity")), list(LEVELS))}
    for depth in (2, 1):
        path = list(LEVELS[:depth])
        usable = F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))
        tree[depth] = weighed(tree[depth + 1].groupBy(*path).agg(usable.alias("capacity")), path)
    # From the root down: each node's budget is divided among its children.
    budget: DataFrame | None = None
    for depth in (1, 2, 3):
        path, nodes = list(LEVELS[:depth]), tree[depth]
        for c in LEVELS[depth:]:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
        if budget is None:
            filled = _fill(nodes.withColumn("root", F.lit(0)).withColumn("budget", total.cast("double")), ["root"])
        else:
            up = budget.select(*[F.col(c).alias(f"u_{c}") for c in path[:-1]], F.col("share").alias("budget"))
            nodes = nodes.join(up, [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in path[:-1]])
            filled = _fill(nodes, path[:-1])
        budget = filled.select(*path, "share")
    return budget.select(*LEVELS, F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def _limited(df: DataFrame, rows: int = BROADCAST_LEAVES) -> DataFrame:
    """``df``, a table, marked for broadcast where it has few rows; AQE splits a skewed join beyond that."""
    return F.broadcast(df) if df.count() <= rows else df


def _mixed(
    df: DataFrame,
    row: Column,
    *,
    weights: DataFrame | None = None,
    budget_fraction: float = 0.8,
    max_epochs: int = 1,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
) -> DataFrame:
    """As :func:`mix`, with ``row`` too, a number of each row."""
    text = F.col(f"`{text_col}`")
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (source_domain(F.col("source")) if domain is None else domain).alias("domain"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        word_tokens(text).alias("n_tokens"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"),
        row.alias("row"),
    )
    rows = materialize(rows, "mix-rows")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    whole = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget_fraction).alias("total"), F.sum("docs").alias("docs")).first()
    plan = budgets(leaves, weights, F.lit(whole["total"]), max_epochs)
    # A leaf of a large share of the table is cut into as many buckets as it would fill partitions, several times over.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_bucket = max(1, min(BUCKET_ROWS, (whole["docs"] or 0) // (4 * partitions)))
    plan = leaves.alias("l").join(plan.alias("p"), [F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in LEVELS], "left").select(
        *[F.col(f"l.{c}").alias(f"k_{c}") for c in LEVELS],
        "tokens",
        F.coalesce("budget", F.lit(0)).alias("budget"),
        F.ceil(F.col("docs") / in_bucket).alias("buckets"),
    )
    plan = plan.withColumn("full_epochs", F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 0 END").cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))
    plan = _limited(materialize(plan, "mix-plan"))
    keyed = rows.join(plan, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in LEVELS])
    epoch = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # 13 hexadecimal digits of the digest: the seeded order of this epoch.
    keyed = keyed.withColumn("place", F.conv(F.substring(epoch, 1, 13), 16, 10).cast("long"))
    keyed = keyed.withColumn("bucket", F.floor(F.col("place") / F.lit(float(1 << 52)) * F.col("buckets")).cast("long"))
    keyed = materialize(keyed.drop("tokens", "buckets", *[f"k_{c}" for c in LEVELS]), "mix-keyed")
    # One row a bucket: what comes before it, and whether the budget ends in it.
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("rest"))
    before = F.sum("in_bucket").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")
    ends = sums.withColumn("before", before).select(
        *[F.col(c).alias(f"k_{c}") for c in LEVELS], F.col("bucket").alias("k_bucket"), "before", (F.col("before") + F.col("in_bucket") <= F.col("rest")).alias("whole")
    )
    ends = _limited(materialize(ends, "mix-ends"))
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in LEVELS] + [F.col("bucket") == F.col("k_bucket")]
    keyed = keyed.join(ends, same)
    done = keyed.where("whole OR before > rest").withColumn("in_partial", F.col("whole"))
    within = Window.partitionBy(*LEVELS, "bucket").orderBy("place", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = keyed.where("NOT whole AND before <= rest").withColumn("in_partial", F.col("before") + F.sum("n_tokens").over(within) <= F.col("rest"))
    partial = F.col("in_partial") & (F.col("rest") > 0)
    return done.unionByName(edge).select(
        "doc_id", *LEVELS, "n_tokens", "row", "budget", "full_epochs", partial.alias("in_partial"), (F.col("full_epochs") + partial.cast("int")).cast("long").alias("copies")
    )


def mix(df: DataFrame, **options: object) -> DataFrame:
    """Per row: doc_id, domain, lang, source, n_tokens, budget, full_epochs, in_partial and copies.

    Options: ``weights`` (a table of level, domain, lang, source, weight), ``budget_fraction`` of the tokens,
    ``max_epochs``, ``seed``, ``id_col``, ``text_col`` and ``domain``, a column.
    """
    return _mixed(df, F.monotonically_increasing_id(), **options).drop("row")


def select_mixture(df: DataFrame, **options: object) -> DataFrame:
    """The rows of ``df`` that :func:`mix` selects, each once for each of its copies; all columns stay."""
    table, row = numbered(df, "mix-input")
    (copies,) = unused(table, "copies")
    chosen = _mixed(table, F.col(row), **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(copies))
    out = table.join(chosen, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.drop(row, copies)


#: Target weights of the registered query: (level, domain, lang, source, weight); nodes that aren't listed weigh 1.
TARGET_WEIGHTS = [(1, "domain0", None, None, 3.0), (1, "domain1", None, None, 2.0), *[(2, f"domain{k}", "en", None, 2.0) for k in range(3)], (3, "domain0", "en", "src0", 0.5)]
MAX_EPOCHS = 3


def _sql_value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)


_SQL_WEIGHTS = ", ".join(f"({', '.join(map(_sql_value, row))})" for row in TARGET_WEIGHTS)


def target_weights(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_SQL_WEIGHTS} AS w(level, domain, lang, source, weight)")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), weights=target_weights(spark), max_epochs=MAX_EPOCHS)


#: ``op9_mixing`` in SQL: four fifths of the tokens, seed 17.
_FILL = """
{name}_o AS (
  SELECT *, coalesce(sum(capacity) OVER w, 0) AS filled, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM ({child}) WHERE capacity > 0 AND weight > 0
  WINDOW w AS (PARTITION BY {parent} ORDER BY capacity / weight, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
{name} AS (
  SELECT {keys}, least(capacity, coalesce(max(CASE WHEN (budget - filled) / open_weight * weight <= capacity THEN (budget - filled) / open_weight END)
         OVER (PARTITION BY {parent}) * weight, capacity)) AS share
  FROM {name}_o
)"""


ORACLE_SQL = {
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, 'domain' || coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS INT) % 3, 0) AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents
),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * 0.8::DOUBLE) AS budget FROM leaf),
w(level, w_domain, w_lang, w_source, weight) AS (VALUES """
    + _SQL_WEIGHTS
    + "),"
    + f"""
c3 AS (SELECT domain, lang, source, (tokens * {MAX_EPOCHS})::DOUBLE AS capacity, coalesce(weight, 1) AS weight
       FROM leaf LEFT JOIN w ON level = 3 AND w_domain = domain AND w_lang = lang AND w_source = source),
s2 AS (SELECT domain, lang, sum(CASE WHEN weight > 0 THEN capacity ELSE 0 END) AS capacity FROM c3 GROUP BY ALL),
c2 AS (SELECT domain, lang, capacity, coalesce(weight, 1) AS weight FROM s2 LEFT JOIN w ON level = 2 AND w_domain = domain AND w_lang = lang),
s1 AS (SELECT domain, sum(CASE WHEN weight > 0 THEN capacity ELSE 0 END) AS capacity FROM c2 GROUP BY ALL),
c1 AS (SELECT domain, capacity, coalesce(weight, 1) AS weight FROM s1 LEFT JOIN w ON level = 1 AND w_domain = domain),"""
    + _FILL.format(name="f1", keys="domain", parent="1", child="SELECT c1.*, budget FROM c1, total")
    + ","
    + _FILL.format(name="f2", keys="domain, lang", parent="domain", child="SELECT c2.*, share AS budget FROM c2 JOIN f1 USING (domain)")
    + ","
    + _FILL.format(name="f3", keys="domain, lang, source", parent="domain, lang", child="SELECT c3.*, share AS budget FROM c3 JOIN f2 USING (domain, lang)")
    + r""",
plan AS (
  SELECT domain, lang, source, coalesce(floor(share + 1e-6)::BIGINT, 0) AS budget, CASE WHEN tokens > 0 THEN coalesce(floor(share + 1e-6)::BIGINT, 0) // tokens ELSE 0 END AS full_epochs, tokens
  FROM leaf LEFT JOIN f3 USING (domain, lang, source)
),
k AS (SELECT d.*, budget, full_epochs, budget - full_epochs * tokens AS rest, ('0x' || substr(md5('17|' || full_epochs || '|' || doc_id), 1, 13))::BIGINT AS place FROM d JOIN plan USING (domain, lang, source)),
p AS (SELECT *, rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS in_partial FROM k)
SELECT doc_id, domain, lang, source, n_tokens, budget, full_epochs, in_partial, full_epochs + in_partial::BIGINT AS copies FROM p
"""
}
