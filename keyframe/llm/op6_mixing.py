"""Mixing sources to target weights by hierarchical budgets (operator 6).

Documents hang on a tree: root, domain, language, source.  The token budget goes
down by the target weights; a node that cannot take its share (its tokens times
MAX_EPOCHS) is filled, and what is left over goes to its siblings by their
weights, and to the parent's siblings only when the whole family is full.  Domains and
languages are budgeted on the driver; sources, of which there may be any number, as rows:
those of a family are full up to a place in the order of capacity over weight.  A
leaf with a budget of b tokens over t tokens gives all its documents floor(b / t)
times and, of the next epoch, the documents of the seeded order that start
before the rest of the budget is used up.

The seeded order is that of a hash of seed, epoch, id and text.  Its prefix is
found from token sums over ranges of the hash, with a running sum only inside
the range where the budget ends, so a source with most of the rows needs no
global sort.

A token is a run of characters other than blanks.  Nulls in lang or source are
names of their own, apart from ''; a text without tokens costs nothing and comes with every epoch in
which its turn comes.  Weights that are missing count as `default`; a level whose
weights are all zero is shared evenly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, cut, table
from .op9_winnowing import BLANKS

SHARE, MAX_EPOCHS, SEED, RANGE_DOCS = 0.8, 2, 17, 2048
#: Leaves (five numbers each) that are broadcast to the documents; more are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Target weights of the registered query, by level; other names have weight 1.
WEIGHTS = {"domain": {"low": 3.0, "high": 2.0}, "lang": {"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0}, "source": {"src0": 3.0}}
LEVELS = ("domain", "lang", "source")
#: Stands before the name of a language or source that is not null.
NAMED = "="


def domain_of(source: Column) -> Column:
    """The registered query's domains: by the last digit of the source's name."""
    return F.when(F.substring(source, -1, 1).isin(*"01234"), "low").otherwise("high")


@dataclass
class Node:
    weight: float
    tokens: int = 0
    budget: int = 0
    children: dict[str, Node] = field(default_factory=dict)

    def capacity(self, epochs: int) -> int:
        return sum(c.capacity(epochs) for c in self.children.values()) if self.children else self.tokens * epochs


def grow(leaves: list[tuple], weights: dict, default: float = 1.0) -> Node:
    """A tree from (domain, lang, source, tokens), or of the upper levels only."""
    root = Node(1.0)
    for *path, tokens in sorted(leaves):
        node = root
        for level, name in zip(LEVELS, path, strict=False):
            node = node.children.setdefault(name, Node(float(weights.get(level, {}).get(name.removeprefix(NAMED), default))))
        node.tokens += tokens
    return root


def spread(node: Node, budget: int, epochs: int) -> None:
    """Give node a budget (at most its capacity) and share it among its children."""
    node.budget = min(budget, node.capacity(epochs))
    open_, left = dict(node.children), node.budget
    given = dict.fromkeys(open_, 0)
    while open_ and left > 0:
        total = sum(c.weight for c in open_.values())
        share = {k: left * (c.weight / total if total else 1 / len(open_)) for k, c in open_.items()}
        full = [k for k, c in open_.items() if given[k] + share[k] >= c.capacity(epochs)]
        if not full:
            whole = {k: int(s) for k, s in share.items()}
            short = left - sum(whole.values())
            for k in sorted(open_, key=lambda k: (whole[k] - share[k], k))[:short]:
                whole[k] += 1
            for k, s in whole.items():
                given[k] += s
            break
        for k in full:
            more = open_.pop(k).capacity(epochs) - given[k]
            given[k] += more
            left -= more
    for k, c in node.children.items():
        spread(c, given[k], epochs)


def leaves_of(node: Node, path: tuple = ()) -> list[tuple]:
    if not node.children:
        return [(*path, node.tokens, node.budget)]
    return [x for k, c in node.children.items() for x in leaves_of(c, (*path, k))]


def spread_rows(leaves: DataFrame, weights: dict, default: float = 1.0) -> DataFrame:
    """leaves (domain, lang, source, tokens, n, capacity, given), given to the family -> the same with budget, as spread has it.

    Weights of zero count only when all others are full, and then alike.
    """
    table = weights.get("source", {})
    name = F.substring("source", len(NAMED) + 1, 1 << 30)
    weight = F.lit(float(default))
    if table:
        found = F.create_map(*[F.lit(x) for k, w in table.items() for x in (k, float(w))])
        weight = F.coalesce(F.try_element_at(found, name), weight)
    family = ["domain", "lang"]
    t = leaves.withColumn("w", weight).withColumn("zero", F.col("w") <= 0).withColumn("w", F.when(F.col("zero"), 1.0).otherwise(F.col("w")))
    first = F.coalesce(F.sum(F.when(~F.col("zero"), F.col("capacity"))).over(Window.partitionBy(*family)), F.lit(0))
    t = t.withColumn("to_share", F.when(F.col("zero"), F.greatest(F.lit(0), F.col("given") - first)).otherwise(F.least("given", first)).cast("long"))
    alike = Window.partitionBy(*family, "zero")
    by_level = alike.orderBy(F.col("capacity") / F.col("w"), "source")
    filled = F.coalesce(F.sum("capacity").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("full", (F.col("to_share") - filled) * F.col("w") / others >= F.col("capacity"))
    left = F.col("to_share") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(alike), F.lit(0))
    t = t.withColumn("left", left).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(alike))
    t = t.withColumn("share", F.when(~F.col("full"), F.greatest(F.lit(0.0), F.col("left") * F.col("w") / F.col("open")))).withColumn("whole", F.floor("share"))
    t = t.withColumn("short", F.col("left") - F.sum("whole").over(alike))
    rank = F.row_number().over(alike.orderBy("full", F.col("whole") - F.col("share"), "source"))
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("whole") + F.when(rank <= F.col("short"), 1).otherwise(0))
    return t.withColumn("budget", budget.cast("long")).select(*leaves.columns, "budget")


def tokens_of(text: Column) -> Column:
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS[1:], BLANKS[0] * (len(BLANKS) - 1))
    return F.size(F.filter(F.split(t, " "), lambda w: w != "")).cast("long")


def mix(docs: DataFrame, weights: dict = WEIGHTS, domain=domain_of, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, domain, lang, source, tokens, epoch, salt; a row for each time a document is taken."""
    spark = docs.sparkSession
    name = {c: F.coalesce(F.concat(F.lit(NAMED), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source")}  # a null is '' until the end
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("domain"), name["lang"].alias("lang"), name["source"].alias("source"), tokens_of(F.col("text")).alias("tokens"), F.xxhash64(F.col("text").cast("string")).alias("salt"))
    rows = cut(rows)
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    found = leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens")).collect()  # one row for each language of a domain
    root = grow([(r.domain, r.lang, r.tokens) for r in found], weights)
    spread(root, int(share * sum(r.tokens for r in found)), epochs)
    given = spark.createDataFrame([(d, lang, b) for d, lang, _, b in leaves_of(root)] if found else [], "domain string, lang string, given long")
    leaves = spread_rows(leaves.withColumn("capacity", F.col("tokens") * epochs).join(given, ["domain", "lang"]), weights)
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(epochs).cast("long")
    plan = leaves.withColumn("full", full).select(*LEVELS, "full", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(0).alias("rest"), F.greatest(F.lit(1), F.floor(F.col("n") / RANGE_DOCS)).cast("long").alias("ranges"))
    plan = cut(plan)
    plan = F.broadcast(plan) if plan.count() <= MAX_BROADCAST else plan
    t = rows.join(plan, list(LEVELS)).withColumn("order", F.xxhash64(F.lit(seed), "full", "doc_id", "salt"))
    t = t.withColumn("range", F.pmod(F.shiftright("order", 24), F.col("ranges")))
    sums = t.where("rest > 0").groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    t = t.join(sums, [*LEVELS, "range"], "left")
    inside = t.where("rest > 0 and before < rest and before + sum > rest")
    run = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("order", "doc_id", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns = ["doc_id", *LEVELS, "tokens", "salt"]
    whole = t.where("full > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"))
    early = t.where("rest > 0 and before + sum <= rest").select(*columns, F.col("full").alias("epoch"))
    last = inside.withColumn("run", F.col("before") + run).where("run < rest").select(*columns, F.col("full").alias("epoch"))
    plain = {c: F.when(F.col(c) != "", F.substring(F.col(c), 2, 1 << 30)) for c in ("lang", "source")}
    return whole.union(early).union(last).withColumns(plain)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("salt")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mixture takes them.

    Rows meet what is taken by id (null is an id here) and text; rows that repeat, which no order tells
    apart, are all taken as often as the one that comes most often.
    """
    taken = mix(docs).groupBy("doc_id", "salt").agg((F.max("epoch") + 1).cast("int").alias("_times")).withColumnRenamed("doc_id", "_id").withColumnRenamed("salt", "_salt")
    on = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("_salt"))
    return boxed(docs).join(taken, on).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
