"""Line dedup by a log-template tree: lines with one template that recur across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, table, written

#: Leading tokens on the way from the token count to a leaf.
DEPTH = 3
#: A line's tokens are compared in this many runs; a line joins its leaf's template if at least ALIKE are equal (0.875).
#: A line with fewer tokens than that can't be so alike and yet differ.
RUNS = 8
ALIKE = 7
#: Lines of one leaf or template are spread over this many keys where they meet its row.
SALTS = 16
#: Different surroundings, and documents, in which a template has to recur.
MIN_DOCS = 10

SPACE = r"[\x20\x09-\x0D]"
TOKEN = r"[^\x20\x09-\x0D]"


def _tokens(line: Column) -> Column:
    """Tokens of a line; one that holds a digit is a variable field. Lines of letters and spaces need no pattern."""
    masked = F.regexp_replace(F.regexp_replace(line, SPACE, " "), "[^ ]*[0-9][^ ]*", "<*>")
    return F.array_remove(F.split(F.when(line.rlike(r"[\x09-\x0D0-9]"), masked).otherwise(line), " "), "")


def _packed(tokens: Column) -> Column:
    """A hash of all tokens, and 32 bits of hash for each of RUNS equal parts, two in a long (null if there are fewer tokens)."""
    n, runs = F.size(tokens), []
    for j in range(RUNS):
        at, to = F.shiftright(n * j, 3), F.shiftright(n * (j + 1), 3)  # RUNS is 2^3
        runs.append(F.xxhash64(F.slice(tokens, at + 1, to - at)).bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = [F.when(n >= RUNS, runs[j].bitwiseOR(F.shiftleft(runs[j + 1], 32))).alias(f"r{j // 2}") for j in range(0, RUNS, 2)]
    return F.struct(F.xxhash64(tokens).alias("all"), *pairs)


def _equal_runs(a: str, b: str) -> Column:
    differ = [F.col(f"{a}.r{j}").bitwiseXOR(F.col(f"{b}.r{j}")) for j in range(RUNS // 2)]
    halves = [h for x in differ for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    return sum((h == 0).cast("int") for h in halves)


def parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, i, leaf, sig, ctx) for every line that is not blank.

    leaf: token count and leading tokens; sig: the tokens' hash and those of RUNS parts; ctx: the leaves of the lines around it."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    tokens = rows.select("doc_id", "th", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), _tokens(x).alias("t"))), lambda s: F.size(s["t"]) > 0).alias("p"))
    keyed = tokens.select(
        "doc_id",
        "th",
        F.transform("p", lambda s: F.struct(s["i"].alias("i"), F.xxhash64(F.size(s["t"]), F.slice(s["t"], 1, DEPTH)).alias("leaf"), _packed(s["t"]).alias("sig"))).alias("p"),
    )
    leaves = keyed.select("*", F.concat(F.array(F.lit(0).cast("long")), F.col("p.leaf"), F.array(F.lit(0).cast("long"))).alias("around"))
    near = leaves.select("doc_id", "th", F.posexplode("p").alias("k", "s"), "around")
    ctx = F.xxhash64(F.element_at("around", F.col("k") + 1), F.element_at("around", F.col("k") + 3))
    return near.select("doc_id", "th", "s.i", "s.leaf", "s.sig", ctx.alias("ctx"))


def _met(lines: DataFrame, per_key: DataFrame, *key: str, how: str = "inner") -> DataFrame:
    """lines with the columns of their key's row (if there is one), which is repeated under each salt."""
    rows = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "th", "i"), F.lit(SALTS)).cast("int")).join(rows, [*key, "_salt"], how).drop("_salt")


def _listed(kinds: DataFrame, heads: DataFrame) -> DataFrame | None:
    """(leaf, all, template): the sequences that join a template of their leaf's list other than its head; None if none do.

    What the head leaves is gone through by falling number of lines, of equals by hash: a sequence joins the first template
    that is alike, or else is the list's next one. Alike sequences share the hash of all runs but one, so only sequences
    that share such a key are compared. In each turn those before all their neighbours are templates, and their neighbours
    are not; who joins which is settled when all templates are known."""
    rest = _met(kinds.where("sig.r0 is not null").select("leaf", "sig", "n", "first.*"), heads, "leaf").where(_equal_runs("sig", "head") < ALIKE)
    runs = [h for j in range(RUNS // 2) for h in (F.col(f"sig.r{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"sig.r{j}", 32))]
    keys = F.array(*[F.xxhash64(F.lit(j), "leaf", *[r for k, r in enumerate(runs) if k != j]) for j in range(RUNS)])
    own = F.struct((-F.col("n")).alias("n"), F.xxhash64("sig").alias("h"), F.col("sig.all").alias("all"))
    keyed = rest.select("leaf", own.alias("own"), F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    near = written(keyed.join(shared, "key"), "near")
    left, templates = near, []
    while not left.isEmpty():
        led = left.join(left.groupBy("key").agg(F.min("own").alias("lead")), "key")
        first = written(led.groupBy("leaf", "own").agg(F.min((F.col("own") == F.col("lead")).cast("int")).alias("m")).where("m = 1").select("leaf", "own"), "first")
        reached = left.join(first, ["leaf", "own"]).select("key").distinct()
        gone = left.join(reached, "key").select("leaf", "own").distinct()
        left = written(left.join(gone, ["leaf", "own"], "left_anti"), "left", instead_of=None if left is near else left)
        templates.append(first)
    if not templates:
        return None
    chosen = templates[0]
    for more in templates[1:]:
        chosen = chosen.unionByName(more)
    by_key = near.join(chosen, ["leaf", "own"]).groupBy("key").agg(F.min("own").alias("lead"))
    joined = near.join(by_key, "key").groupBy("leaf", "own").agg(F.min("lead").alias("lead"))
    own_list = joined.join(chosen, ["leaf", "own"], "left_anti")  # a template stays its own
    return written(own_list.select("leaf", F.col("own.all").alias("all"), F.col("lead.all").alias("template")), "listed")


def _dropped(lines: DataFrame, min_docs: int, surroundings: bool) -> DataFrame:
    """(doc_id, th, dropped): numbers of the lines to drop, for documents that have any."""
    busy = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    some = written(_met(lines, busy, "leaf"), "lines", instead_of=lines)
    kinds = written(some.groupBy("leaf", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "i")).alias("first")), "kinds")
    # the leaf's first template: the sequence with the most lines, of equals the one met first
    heads = kinds.groupBy("leaf").agg(F.min_by("sig", F.struct((-F.col("n")).alias("n"), "first")).alias("head"))
    listed = _listed(kinds, heads)
    met = _met(some, heads, "leaf").withColumn("all", F.col("sig.all"))
    met = met.withColumn("template", F.col("all")) if listed is None else _met(met, listed, "leaf", "all", how="left")
    template = F.when(_equal_runs("sig", "head") >= ALIKE, F.col("head.all")).otherwise(F.coalesce("template", "all"))
    named = written(met.select("doc_id", "th", "i", "ctx", "leaf", template.alias("sig")), "templates", instead_of=some)
    forget(kinds)
    key = ["leaf", "sig"]
    first = F.min(F.struct("doc_id", "th", "i"))
    if surroundings:
        n_ctx = named.groupBy(*key, "ctx").agg(F.count(F.lit(1)).alias("_")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_ctx"))
        n_docs = named.groupBy(*key, "doc_id", "th").agg(F.min("i").alias("i")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_docs"), first.alias("first"))
        recurring = n_docs.join(n_ctx, key).where((F.col("n_docs") >= min_docs) & (F.col("n_ctx") >= min_docs) & (2 * F.col("n_ctx") >= F.col("n_docs")))
    else:
        n_texts = named.groupBy(*key, "th").agg(first.alias("first")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_texts"), F.min("first").alias("first"))
        recurring = n_texts.where(F.col("n_texts") >= min_docs)
    later = _met(named, recurring.select(*key, "first"), *key).where(~F.struct("doc_id", "th", "i").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("i")).alias("dropped"))


def without_templates(docs: DataFrame, min_docs: int = MIN_DOCS, surroundings: bool = True) -> DataFrame:
    """docs with `kept_text`, `n_lines` (not blank) and `n_dropped`.

    The tree is of fixed depth: token count, then DEPTH leading tokens, tokens with a digit being variable fields. A
    line of RUNS tokens or more joins the first template in its leaf's list of which at least ALIKE of RUNS parts are equal
    to its own, so the parts that vary are generalised too; else its sequence is the list's next template. The list begins
    with the leaf's most frequent sequence. A template recurs if it is in min_docs documents and has min_docs
    different surroundings, at least half as many as documents: one with the same lines around it everywhere is a copied
    document, which is for near-duplicate stages to judge. Without `surroundings` it recurs if it is in min_docs different
    texts, so whole copies count once and the lines inside a block of boilerplate go too. Of a recurring template the first line (by doc_id) stays and
    the others are dropped. Blank lines stay. Counts are over all lines of all documents, summed before they are dealt.

    A null text has no lines and stays null. Rows with equal doc_id (nulls too) and text are one document, so their
    lines count once and are dropped alike. Other columns are kept, but those with a result's name give way to it; very
    long texts are read whole; an empty table gives an empty result."""
    names = ("kept_text", "n_lines", "n_dropped")
    return _cleaned(docs.drop(*names), names, min_docs, surroundings)


def _cleaned(docs: DataFrame, names: tuple[str, ...], min_docs: int = MIN_DOCS, surroundings: bool = True) -> DataFrame:
    gone = _dropped(written(parsed(docs), "parsed"), min_docs, surroundings)
    doc, hash_, dropped, own = fresh([*docs.columns, *names], "doc", "hash", "dropped", "own")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("th").alias(hash_), F.col("dropped").alias(dropped))
    lines = F.split("text", "\n", -1)
    marked = docs.withColumn(own, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(hash_)), "left")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(dropped), i)), "\n")
    return marked.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(dropped).isNull(), F.col("text")).otherwise(kept).alias(names[0]),
        F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(TOKEN))), F.lit(0)).cast("long").alias(names[1]),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias(names[2]),
    )


def without_template_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines gone that `without_templates` drops without `surroundings`, and n_chars (where there is such a
    column) of what stays; documents of which nothing else is left go too. All columns are kept under their names."""
    names = fresh(docs.columns, "kept", "lines", "gone")
    kept, _, gone = map(F.col, names)
    out = _cleaned(docs, tuple(names), min_docs, False).where((gone == 0) | kept.rlike(TOKEN))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(gone == 0, F.col("n_chars")).otherwise(F.length(kept).cast("long")))
    return out.withColumn("text", kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = without_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
with x as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
  from documents),
t as (
  select doc_id, i, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''),
                                   lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end) as t
  from x where regexp_matches(line, '[^\x20\x09-\x0D]')),
l as (select doc_id, i, t, (len(t), t[1:3]) as leaf from t),
c as (
  select *, (lag(leaf) over w, lead(leaf) over w) as ctx from l window w as (partition by doc_id order by i)),
k as (select leaf, t, count(*) as n, min((doc_id, i)) as first from c group by leaf, t),
h as (select leaf, arg_min(t, (-n, first)) as head from k group by leaf),
n as (
  select c.*, case when len(t) >= 8 and len(list_filter(range(0, 8), lambda j: t[(j * len(t)) // 8 + 1 : ((j + 1) * len(t)) // 8] = head[(j * len(t)) // 8 + 1 : ((j + 1) * len(t)) // 8])) >= 7
                   then head else t end as template
  from c join h on c.leaf = h.leaf),
r as (
  select template, min((doc_id, i)) as first from n group by template
  having count(distinct doc_id) >= 10 and count(distinct ctx) >= 10 and 2 * count(distinct ctx) >= count(distinct doc_id)),
g as (select doc_id, i from n join r on n.template = r.template where (doc_id, i) <> first),
o as (
  select x.doc_id, string_agg(case when g.i is null then line end, chr(10) order by x.i) as kept,
         count(*) filter (where regexp_matches(line, '[^\x20\x09-\x0D]')) as n_lines, count(g.i) as n_dropped
  from x left join g on x.doc_id = g.doc_id and x.i = g.i group by x.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join o on d.doc_id = o.doc_id
"""
