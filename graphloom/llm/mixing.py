"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import uniform, uniform_duckdb

#: A source's target weight is its size to this power (1: as it is, 0: all sources alike).
EXPONENT = 0.7
#: No document is repeated more often than this.
MAX_EPOCHS = 2.0
SEED = "mix-1"


def fill(
    sources: DataFrame, exponent: float = EXPONENT, max_epochs: float = MAX_EPOCHS, total: float | None = None, weights: dict[str, float] | None = None
) -> DataFrame:
    """(source, size) -> (source, size, weight, epochs).

    ``weights`` are the target weights by source (in any unit; a source that isn't named or has no positive weight gets
    none and 0 epochs); without them a source's weight follows its size to the power ``exponent``.  Each source should supply total * weight, at most max_epochs * size.  Where the caps bind, what is
    over goes to the others in proportion to their weights, until no cap is exceeded; if all are capped
    the total stays below its target.  This is the fixed point of clamping and redistributing: with
    the sources in the order of size / weight the capped ones come first, so running sums decide it.
    The default total is the least with which, before clamping, every source is used at least once.
    Sources are few next to the documents, and only their sums are sorted in one place."""
    weighted = sources.where("size > 0").withColumn("mass", F.pow(F.col("size").cast("double"), F.lit(float(exponent))))
    if weights is not None:
        given = sources.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, mass double")
        every = weighted.drop("mass").join(given, "source", "left")
        weighted, unused = every.where("mass is not null"), every.where("mass is null")
    everything = Window.partitionBy(F.lit(0))
    weighted = weighted.withColumn("weight", F.col("mass") / F.sum("mass").over(everything))
    goal = F.lit(float(total)) if total is not None else F.max(F.col("size") / F.col("weight")).over(everything)
    weighted = weighted.withColumn("goal", goal).withColumn("room", F.lit(float(max_epochs)) * F.col("size"))
    before = Window.orderBy(F.col("room") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("goal") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (F.lit(1.0) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first uncapped source has the right level, and later ones only lower ones; a source is capped when the level that the uncapped rest would share exceeds its room
    tried = weighted.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("room"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    share = F.when(F.col("capped"), F.col("room")).otherwise(final * F.col("weight"))
    filled = tried.select("source", "size", "weight", (share / F.col("size")).alias("epochs"))
    return filled if weights is None else filled.union(unused.select("source", "size", F.lit(0.0), F.lit(0.0)))


def plan(docs: DataFrame, exponent: float = EXPONENT, max_epochs: float = MAX_EPOCHS, total: float | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The epochs of every source of docs; a source's size is the sum of n_chars (null or negative: 0)."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce(F.col("n_chars").cast("bigint"), F.lit(0)), F.lit(0))).alias("size")
    )
    return fill(sizes, exponent, max_epochs, total, weights)


def copies(key: Column, epochs: Column, seed: str = SEED) -> Column:
    """Whole epochs, and one more for the seeded share of documents that the fraction asks for."""
    drawn = F.expr(uniform("__gl_key", seed))
    return F.floor(epochs).cast("int") + F.when(drawn < epochs - F.floor(epochs), 1).otherwise(0)


def mix(docs: DataFrame, exponent: float = EXPONENT, max_epochs: float = MAX_EPOCHS, total: float | None = None, seed: str = SEED, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with every row as often as its source's epochs ask for, and the column ``__gl_copy`` (1, 2, ...).

    The draw depends on the seed and doc_id alone: repeated rows are drawn alike, a null doc_id counts as
    an empty one.  A null source is a source of its own (the empty name).  A source of size 0 can't be
    weighed and its rows are kept once.  Texts don't matter.  An empty table gives an empty one."""
    epochs = plan(docs, exponent, max_epochs, total, weights).select(F.col("source").alias("__gl_source"), F.col("epochs").alias("__gl_epochs"))
    keyed = docs.withColumn("__gl_source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__gl_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = copies(F.col("__gl_key"), F.coalesce(F.col("__gl_epochs"), F.lit(1.0)), seed)
    counted = keyed.join(epochs, "__gl_source", "left").withColumn("__gl_copies", number).where("__gl_copies > 0")
    return counted.withColumn("__gl_copy", F.explode(F.sequence(F.lit(1), F.col("__gl_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns], "__gl_copy")


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, copy)."""
    return mix(docs.select("doc_id", "source", "n_chars")).withColumnRenamed("__gl_copy", "copy")


def sql(table: str = "documents", columns: str = "doc_id, source, n_chars, copy", exponent: float = EXPONENT, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> str:
    return f"""with sizes as (
  select coalesce(source, '') as s, sum(greatest(coalesce(n_chars, 0), 0))::BIGINT as size from {table} group by 1
), masses as (
  select s, size, pow(size::DOUBLE, {exponent!r}) as mass from sizes where size > 0
), weights as (select *, mass / sum(mass) over () as weight from masses
), rooms as (select *, max(size / weight) over () as goal, {max_epochs!r}::DOUBLE * size as room from weights
), levels as (
  select *, (goal - coalesce(sum(room) over before, 0)) / (1 - coalesce(sum(weight) over before, 0)) as level
  from rooms window before as (order by room / weight, s rows between unbounded preceding and 1 preceding)
), tried as (select *, level * weight >= room as capped from levels
), epochs as (
  select s, case when capped then room else max(level) filter (where not capped) over () * weight end / size as e from tried
), drawn as (
  select d.*, coalesce(e, 1.0)::DOUBLE as e, {uniform_duckdb("coalesce(d.doc_id::VARCHAR, '')", seed)} as u
  from {table} d left join epochs on s = coalesce(source, '')
)
select {columns} from (
  select *, unnest(range(1, (floor(e) + case when u < e - floor(e) then 1 else 0 end)::BIGINT + 1))::INT as copy from drawn)"""
