"""Mixing sources to target weights by thresholds on a hash of the document, found from nested histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

#: A histogram splits a range of hash values into this many buckets; LEVELS of them, each inside a bucket of the one before.
BITS = 12
LEVELS = 3
#: Rows of one source are spread over this many keys where they meet their source's row.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def _hash() -> Column:
    own = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 12), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of the text, and 48 bits of the id's MD5 (of the text's where the id is null)."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        _hash().alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): weights by code point of the source, null last, repeating.

    The target is min(weight * level, most * size) at the level that shares out all words. Sources are put in order of
    the level at which they are full; the level follows from sums over those before. One row per source from here on."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("i", F.lit(len(weights))) + 1).cast("int"))
    full = F.lit(float(most)) * F.col("source_size")
    w = ordered.select("source", "source_size", weight.alias("w"), full.alias("full"), "i")
    at = Window.orderBy(F.col("full") / F.col("w"), "i")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    after = at.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # the first source that is not full at the level left over for it and all after it fixes that level
    levels = w.withColumn("level", level).withColumn("open", F.col("full") > F.col("w") * F.col("level"))
    fixed = levels.withColumn("fixed", F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("w"), "i", "level"))).over(whole)["level"])
    target = F.when(F.col("fixed").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("w") * F.col("fixed")))
    return fixed.select("source", "source_size", F.round(target, 6).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("h", 48 - BITS * (level + 1))


def _met(rows: DataFrame, per_source: DataFrame, h: str = "h") -> DataFrame:
    """rows with their source's columns: per_source is repeated under each salt, so that no source's rows share a task."""
    source, salt = fresh([*rows.columns, *per_source.columns], "_source", "_salt")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    salted = per_source.select(key.alias(source), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), *[c for c in per_source.columns if c != "source"])
    return rows.withColumn(source, key).withColumn(salt, F.pmod(F.xxhash64(h), F.lit(SALTS)).cast("int")).join(salted, [source, salt]).drop(source, salt)


def thresholds(sized: DataFrame, per: DataFrame) -> DataFrame:
    """per with `whole` (copies of every document) and `cut`: documents with h < cut are taken once more.

    The words wanted beyond whole copies are a budget. Words are summed by source and hash bucket; running sums show the
    bucket in which the budget runs out, and only that bucket's documents are summed again in finer buckets. The last,
    finest bucket is taken or left, whichever ends nearer to the budget."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(1e-9)).cast("long")
    now = per.withColumn("whole", whole).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("base", F.lit(0).cast("long"))
    for level in range(LEVELS):
        inside = _met(sized, now.select("source", "base")).where(_bucket(level - 1) == F.col("base")) if level else sized
        histogram = inside.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("words"))
        to = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        sums = histogram.withColumn("to", to).alias("s").join(now.alias("n"), F.col("s.source").eqNullSafe(F.col("n.source")))
        # the first bucket at whose end the budget is reached; none if the budget exceeds all that is there
        edge = sums.where(F.col("to") >= F.col("left")).groupBy(F.col("n.source").alias("source")).agg(F.min(F.struct("b", "to", "words")).alias("e"))
        joined = now.alias("n").join(edge.alias("e"), F.col("n.source").eqNullSafe(F.col("e.source")), "left")
        none = F.col("e.e").isNull()
        base = F.when(none, F.col("n.base") * (1 << BITS) + (1 << BITS)).otherwise(F.col("e.e.b"))
        left = F.when(none, 0.0).otherwise(F.col("n.left") - (F.col("e.e.to") - F.col("e.e.words")))
        if level == LEVELS - 1:
            base = base + F.when(~none & (F.col("n.left") > 0) & (2 * left > F.col("e.e.words")), 1).otherwise(0)
        now = written(joined.select("n.source", "n.source_size", "n.target", "n.whole", left.alias("left"), base.alias("base")), "budget")
    return now.select("source", "source_size", "target", "whole", F.shiftleft("base", 48 - BITS * LEVELS).alias("cut"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sized (from `sizes`; more columns may follow) with source_size, target and copies, how often each row is taken.

    Every row of a source is taken floor(target / size) times, and rows under the source's hash threshold once more; so
    the choice is the same in every run, no row is taken more than `most` times, and a source's taken words miss its
    target by less than one document (rows of one id share a hash and are taken together). Rows are never sorted. Columns of
    sized that have a result's name give way to it. Null sources form a source of their own; null and empty texts have size 0; an empty table gives an empty result."""
    sized = sized.drop("source_size", "target", "copies")
    whole, cut = fresh([*sized.columns, "source_size", "target", "copies"], "whole", "cut")
    per = thresholds(sized, written(targets(sized, weights, most), "targets")).withColumnsRenamed({"whole": whole, "cut": cut})
    return _met(sized, per).withColumn("copies", F.col(whole) + (F.col("h") < F.col(cut)).cast("long")).drop(whole, cut)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: rows of docs, repeated as often as they are taken, with their columns.

    The texts stay where they are until they are written: only the table of thresholds comes to them. Columns of any name
    come through as they are."""
    h, whole, cut, n = fresh(docs.columns, "h", "whole", "cut", "n")
    own = written(sizes(docs), "sizes")
    per = thresholds(own, written(targets(own, weights, most), "targets")).select("source", F.col("whole").alias(whole), F.col("cut").alias(cut))
    taken = _met(docs.withColumn(h, _hash()), per, h).withColumn(n, F.col(whole) + (F.col(h) < F.col(cut)).cast("long")).where(F.col(n) > 0)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    sized = written(sizes(table(spark, sf_dir, "documents")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 12))::bigint >> 12 as g
  from documents),
s as (
  select source, sum(size)::bigint as source_size, 3.0::double * sum(size)::double as full_size,
         (((row_number() over (order by source nulls last) - 1) % 3) + 1)::double as w
  from d group by source),
l as (
  select *, (sum(source_size) over ()
      - coalesce(sum(full_size) over (order by full_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by full_size / w, source nulls last rows between current row and unbounded following) as level
  from s),
f as (select arg_min(level, full_size / w) as fixed from l where full_size > w * level),
t as (
  select source, source_size, round(case when fixed is null then full_size else least(full_size, w * fixed) end, 6)::double as target
  from l left join f on true),
b as (
  select *, case when source_size > 0 then floor(target / source_size + 1e-9)::bigint else 0 end as whole from t),
u as (  -- documents that share the finest bucket are one unit
  select d.source, g, sum(size) as words, sum(sum(size)) over (partition by d.source order by g) as upto
  from d group by d.source, g),
c as (
  select u.source, u.g, b.source_size, b.target, b.whole,
         (upto - words + words / 2.0) < greatest(0, target - whole * source_size) as more
  from u join b on u.source is not distinct from b.source)
select d.doc_id, d.size, c.source_size, c.target, ((c.whole + c.more::int) * d.size)::bigint as taken
from d join c on d.source is not distinct from c.source and d.g = c.g
"""
