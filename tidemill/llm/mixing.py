"""Mixing sources to target weights by entropy balancing.

The mix is the one closest to the corpus in relative entropy, token by token,
that meets each source's token target, keeps the mean log length of documents
near the corpus's, and never takes a document more than ``cap`` times.  Its
documents have exponentially tilted rates cap * e^z / (cap - 1 + e^z) with
z = lambda(source) + nu * x(document), x the document's centred log length.
Newton steps on the convex dual find lambda and nu; every step sums over the
documents, binned by source and size.  Rates are then rounded to whole copies
so that token totals stay near their targets.  Everything is DataFrame
operations, and sums are of decimals, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut, free_name

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of one (source, size) bin, so that no window holds a hot bin whole.
SALTS = 64
#: Weight of keeping the mean log length against staying near the corpus.
RIDGE = 0.1
ROUNDS = 100
#: No lambda moves farther than this in a step; up to SURE a whole Newton step needs no search.
FARTHEST, SURE = 8.0, 0.05
#: Shares of a Newton step among which the dual's value decides.
BACKTRACK = (1, 0.5, 0.25, 0.125, 0.0625, 0.015625, 0.00390625, 0.000244140625)


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each whole text, 0 for null."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def _exact(term):
    """Sum of doubles that does not depend on their order."""
    return F.coalesce(F.sum(term.cast("decimal(30,9)")).cast("double"), F.lit(0.0))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): the weighted shares of all tokens, water-filled under cap x size.

    Weights go to sources in code-point order, null last, repeating.  Sources
    are ranked by a range partitioning and the counts of its parts; the level
    at which a source's share is level * weight rises from the plain share as
    sources fill up, two sums a round.  No task needs all sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = ["missing", "code"]
    ranged = per.withColumns({"missing": F.col("source").isNull(), "code": F.encode("source", "utf-8")}).repartitionByRange(*order)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    turn = (F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + offset) % len(weights)
    weighted = cut(ranged.select("source", "source_size", (cap * F.col("source_size")).cast("double").alias("most"), F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")).alias("weight")))
    first = weighted.agg(F.sum("source_size").alias("tokens"), F.sum("weight").alias("weight")).first()
    level = (first.tokens or 0) / (first.weight or 1)
    while True:
        full = F.col("most") < level * F.col("weight")
        now = weighted.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        higher = ((first.tokens or 0) - now.full) / now.open if now.open else level
        if higher <= level:
            break
        level = higher
    return weighted.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def tilts(bins: DataFrame, goals: DataFrame, cap: int = CAP, ridge: float = RIDGE, close: float = 1e-9) -> DataFrame:
    """(source, size, n, source_size, target, rate) from bins (source, size, n) and goals, by Newton steps on the dual.

    The dual is the sum over documents of size * cap * log(cap - 1 + e^z), less
    lambda * target of each source, plus tokens * ridge * nu^2 / 2.  Its
    curvature is diagonal but for nu, so a step needs five sums a source and
    a few numbers in all.  A long step is scaled as a whole: its share is the
    one of BACKTRACK that lowers the dual most, so the dual falls each round.  A source whose target is its cap has no finite lambda
    and takes rate ``cap``; one without tokens or target 0.
    """
    size, x = F.col("size").cast("double"), F.log(F.col("size").cast("double"))
    corpus = bins.where("size > 0").agg(_exact(F.col("n") * size).alias("tokens"), _exact(F.col("n") * size * x).alias("logs")).first()
    tokens = corpus.tokens or 1.0
    inside = (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    goals = goals.withColumn("inside", inside)
    named = bins.select(F.col("source").alias("s"), "size", "n").withColumn("x", F.when(F.col("size") > 0, x - corpus.logs / tokens).otherwise(0.0))
    wide = cut(named.join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s"))
    edge = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.lit(float(cap))).otherwise(0.0)

    def rate(z):
        z = F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))
        return F.when(F.col("inside"), cap * F.exp(z) / (cap - 1 + F.exp(z))).otherwise(edge)

    def soft(z):
        return F.log(cap - 1 + F.exp(F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))))

    mass, even = F.col("n") * size, F.col("target") / F.col("source_size")
    # with nu = 0 the dual is solved by the rate target / source_size in each source, so that is where it starts
    lam = F.when(F.col("inside"), F.log(even * (cap - 1) / (cap - even))).otherwise(0.0)
    state, nu = goals.select(F.col("source").alias("s"), lam.alias("lam")), 0.0
    for _ in range(ROUNDS):
        z = F.col("lam") + nu * F.col("x")
        bend = F.when(F.col("inside"), mass * rate(z) * (1 - rate(z) / cap)).otherwise(0.0)
        placed = wide.join(state, F.col("source").eqNullSafe(F.col("s")))
        sums = placed.groupBy("s", "lam", "inside", "target", "source_size").agg(
            _exact(mass * rate(z)).alias("taken"), _exact(bend).alias("bend"), _exact(bend * F.col("x")).alias("mixed"), _exact(mass * rate(z) * F.col("x")).alias("moment"), _exact(bend * F.col("x") * F.col("x")).alias("spread")
        )
        gap = F.when(F.col("inside"), F.col("taken") - F.col("target")).otherwise(0.0)
        sums = cut(sums.withColumns({"gap": gap, "bend": F.greatest("bend", 1e-12 * F.col("source_size"), F.lit(1e-12))}))
        told = sums.agg(
            _exact(F.col("moment")).alias("moment"), _exact(F.col("spread")).alias("spread"), _exact(F.col("mixed") * F.col("gap") / F.col("bend")).alias("cross"),
            _exact(F.col("mixed") * F.col("mixed") / F.col("bend")).alias("square"), F.max(F.abs("gap") / F.greatest("source_size", F.lit(1))).alias("off"),
            F.max(F.abs(F.col("gap") / F.col("bend"))).alias("own"), F.max(F.abs(F.col("mixed") / F.col("bend"))).alias("shared"),
        ).first()
        slope = told.moment + tokens * ridge * nu
        if (told.off or 0.0) < close and abs(slope) < close * tokens:
            break
        step = (slope - told.cross) / (told.spread + tokens * ridge - told.square)
        longest = told.own + abs(step) * told.shared  # no lambda moves farther than this
        whole = min(1.0, FARTHEST / max(longest, 1e-300), FARTHEST / 4 / max(abs(step), 1e-300))
        move = F.when(F.col("inside"), (F.col("gap") - F.col("mixed") * step) / F.col("bend")).otherwise(0.0)
        state = sums.select("s", "lam", move.alias("move"))
        t = whole
        if longest > SURE:  # else the curvature hardly changes on the way and a whole step goes down
            shares, ahead = [whole * k for k in BACKTRACK], wide.join(state, F.col("source").eqNullSafe(F.col("s")))
            # the dual's change for each share of the step, all in one pass
            rise = ahead.agg(*(
                _exact(F.when(F.col("inside"), mass * (cap * (soft(z - k * (F.col("move") + step * F.col("x"))) - soft(z)))).otherwise(-mass * edge * F.col("x") * k * step)).alias(f"d{i}") for i, k in enumerate(shares)
            ), *(_exact(mass * F.when(F.col("inside"), F.col("move") * F.col("target") / F.col("source_size")).otherwise(0.0)).alias(name) for name in ["held"])).first()
            value = [rise[f"d{i}"] + k * rise.held + tokens * ridge * ((nu - k * step) ** 2 - nu**2) / 2 for i, k in enumerate(shares)]
            t = whole if min(value) > -1e-5 else shares[value.index(min(value))]
        state = state.select("s", (F.col("lam") - t * F.col("move")).alias("lam"))
        nu -= t * step
    else:
        raise RuntimeError(f"the dual is not solved after {ROUNDS} Newton steps")
    solved = wide.join(state, F.col("source").eqNullSafe(F.col("s")))
    return solved.select("source", "size", "n", "source_size", "target", F.round(rate(F.col("lam") + nu * F.col("x")), 7).alias("rate"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, rate, copies, taken.

    Rounding: documents of a source, in order of size and then of a hash of
    the id, share out the running sum of their rates, so the error in tokens is
    at most half of the largest size; then one document of a source has one
    copy more or less where that brings the source nearer its target.  Copies
    are 0 to ``cap``; equal input gives equal output; repeated rows count each;
    empty texts (size 0) are taken as often as their rate says.  A null source
    is a source of its own; no rows give no rows.
    """
    sizes = cut(token_sizes(docs, id_col, text_col, source_col))
    goals = cut(targets(sizes, weights, cap))
    spread = F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"))
    rows = sizes.withColumn("h", spread).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    bins = cut(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    rates = cut(tilts(bins.groupBy("source", "size").agg(F.sum("n").alias("n")), goals, cap).withColumn("rate", F.col("rate").cast("decimal(9,7)")))
    of_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_salt = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("rate") * F.col("n").cast("decimal(18,0)")
    smaller = rates.withColumn("smaller", F.coalesce(F.sum(share).over(of_size), F.lit(0)).cast("decimal(30,7)"))
    among = bins.select(F.col("source").alias("s1"), F.col("size").alias("z1"), F.col("salt").alias("k1"), F.coalesce(F.sum("n").over(of_salt), F.lit(0)).alias("among"))
    first = among.join(smaller, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1"))).select("s1", "z1", "k1", "among", "smaller", "source_size", "target", "rate")
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h", "doc_id")))
    placed = placed.join(first, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1")) & (F.col("salt") == F.col("k1")))
    index = F.col("among") + F.col("nth")
    running = lambda i: F.floor(F.col("smaller") + F.col("rate") * i.cast("decimal(18,0)") + F.lit("0.5").cast("decimal(2,1)")).cast("long")
    copies = F.least(F.lit(cap), running(index) - running(index - 1)).cast("int")
    out = cut(placed.select("doc_id", "source", "size", "source_size", "target", F.col("rate").cast("double").alias("rate"), copies.alias("copies"), "h", "nth"))
    out = _repaired(out, cap)
    return out.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _repaired(out: DataFrame, cap: int) -> DataFrame:
    """In each source, one copy more or less of the document that brings its total nearest the target."""
    gap = out.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).select(F.col("source").alias("s1"), "gap")
    move = F.when(F.col("gap") > 0, F.lit(1)).otherwise(F.lit(-1))
    after = F.abs(F.col("gap") - move * F.col("size"))
    can = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (after < F.abs("gap"))
    key = F.struct(after.alias("after"), "h", "nth", "doc_id", "size")
    best = out.join(gap, F.col("source").eqNullSafe(F.col("s1"))).where(can).groupBy("source").agg(F.min(F.struct(key.alias("key"), move.alias("move"))).alias("b"))
    best = best.select(F.col("source").alias("s1"), F.col("b.key.h").alias("h1"), F.col("b.key.nth").alias("n1"), F.col("b.key.doc_id").alias("d1"), F.col("b.key.size").alias("z1"), F.col("b.move").alias("move"))
    same = F.col("source").eqNullSafe(F.col("s1")) & (F.col("h") == F.col("h1")) & (F.col("nth") == F.col("n1")) & F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("size") == F.col("z1"))
    return out.join(best, same, "left").select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("copies") + F.coalesce("move", F.lit(0))).cast("int").alias("copies"), "h", "nth")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with column ``copy`` (1, 2, ..) more.

    Columns of ``docs`` stay as they are: where one is called ``copy``, the new
    one is ``copy_``.  Rows that share an id share the largest number of copies
    among them.
    """
    own, copy = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), free_name(docs, "copy")
    copies = mixed(docs, id_col, text_col, source_col, **options).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    joined = docs.select(own.alias("own"), F.col(id_col).alias("id")).join(copies, F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.select("own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("own.*", F.col("nth").alias(copy))
