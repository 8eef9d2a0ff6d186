"""Document fingerprints by winnowing, in DataFrame operations only (operator 9).

A text is its sequence of code points, blanks among them.  Every CHARS consecutive
ones have a polynomial hash modulo PRIME, rolled up by doubling: the hash of 2m code points
at a place is that of the m there times BASE**m plus that of the m after them, so each is
made once from hashes that its neighbours use too.  Of each SPAN consecutive hashes the least is chosen, the
rightmost of equals, and kept with its position.  Two texts that share
CHARS + SPAN - 1 = 23 consecutive code points share a mark.  In a text with fewer
than WINDOWS * SPAN grams the span is halved until WINDOWS of it fit (1 at least),
so short texts keep several marks; the least of a window is the least of every
smaller one that holds it, so what is shared is found across sizes too, and two
texts of 15 code points or more that share their first half share a mark.  A text
with fewer code points than CHARS has one gram; an empty one has no marks.

A mark is one long: HASH_BITS of the scrambled hash above POSITION_BITS that count down
from the largest position, so the least long of a window is the least hash and,
of equals, the rightmost.  Positions count modulo 2**POSITION_BITS.  The fingerprint lists the marks in hexadecimal; the
likeness of two is the Jaccard similarity of their hashes (1 if both are empty).

Hashes, marks and least marks are columns: a row holds BLOCK grams of one text, a column
each, and every doubling is one compiled projection; blocks are put together again by text,
in the same stage.  An edited text is the front of its text and the front of the next one.
Where both are long enough for windows of SPAN, its marks are theirs but for the windows
across the join and the last one, which alone are worked out anew; the result is the same.

Documents meet their successor in buckets of BUCKET consecutive ids, each with a
copy of the first document of the next bucket that has any; no global sort.
Null text is empty.  A row without doc_id has no successor (an empty one).
Rows that share a doc_id follow each other in the order of their texts.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table, table_bytes

CHARS, SPAN, WINDOWS = 8, 16, 8
#: Grams whose windows one row holds while marks are found, a column each.  Beyond spark.sql.codegen.maxFields
#: (100), each step is compiled in small methods; fused into one, they would be too large for the JVM to compile.
BLOCK = 128
#: The largest prime of which a product of two residues fits a long, and a base.
PRIME, BASE = 3_037_000_493, 1_000_003_717
#: Bytes of text that one task should read.
TASK_BYTES = 32 << 20
HASH_BITS, POSITION_BITS = 35, 28
BUCKET, SUPER = 1024, 4096
#: Rows of (id, bucket) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
#: The blanks between words, the first replacing the others.
BLANKS = " \t\n\x0b\f\r"


def _mark(h: str, at: str) -> str:
    last = (1 << POSITION_BITS) - 1
    return f"(shiftleft({h} & {(1 << HASH_BITS) - 1}, {POSITION_BITS}) | (({at} & {last}) ^ {last}))"


def block_marks(df: DataFrame, text: str, once: tuple[str, ...] = (), part: str = "false") -> DataFrame:
    """Replace column `text` by `_block` and `_marks`, with a row for each BLOCK grams of it.

    `_marks` are those of the windows that start in block `_block`, from 0; each row of df has
    one block at least.  Columns `once` are null after the first.  Where `part` holds, the
    text is part of a long one, so its windows have SPAN grams.
    """
    keep = [f"`{c}`" for c in df.columns if c not in (text, *once)] + [f"if(_block = 0, `{c}`, null) as `{c}`" for c in once]
    grams = BLOCK + SPAN - 1
    t = df.withColumn("_b", F.coalesce(F.col(text), F.lit(""))).withColumn("_m", F.char_length("_b")).withColumn("_b", F.encode("_b", "UTF-32")).withColumn("_n", F.greatest(F.col("_m") - (CHARS - 1), F.lit(1)))
    t = t.selectExpr("*", f"if({part}, {SPAN * WINDOWS}, _n) as _long", f"explode(sequence(0, (_n - 1) div {BLOCK})) as _block").selectExpr("*", f"_block * {BLOCK} as _at", f"(_block + 1) * {BLOCK} as _next")
    t = t.selectExpr(*keep, "_block", "_m", "_long", "_at", "_next", "_n - _at as _left", f"substring(_b, cast(4 * _at + 1 as int), {4 * (grams + CHARS - 1)}) as _b")
    keep = [f"`{c}`" for c in df.columns if c != text] + ["_block", "_m", "_long", "_at", "_next", "_left"]

    def step_on(t: DataFrame, count: int, value, *more: str) -> DataFrame:
        return t.selectExpr(*keep, *more, *[f"{value(j)} as _{j}" for j in range(count)])

    n = grams + CHARS - 1
    t = step_on(t, n, lambda j: f"pmod(xxhash64(substring(if(_m >= 0, _b, null), {4 * j + 1}, 4)), {PRIME})", f"{_mark('xxhash64(_b)', '0')} as _whole")
    keep.append("_whole")
    step = 1
    while step < CHARS:  # the hash of each `step` consecutive code points -> that of each 2 * step
        n -= step
        t = step_on(t, n, lambda j: f"(_{j} * {pow(BASE, step, PRIME)} + _{j + step}) % {PRIME}")  # noqa: B023
        step *= 2
    # what lies behind the last gram is never least
    t = step_on(t, n, lambda j: f"if({j} < _left, {_mark(f'xxhash64(_{j})', f'(_at | {j})' if j < BLOCK else f'(_next | {j - BLOCK})')}, {(1 << 63) - 1})")
    step, span = 1, "1"
    while step < SPAN:  # the least of each `step` neighbours -> the least of each 2 * step
        n -= step
        t = step_on(t, n, lambda j: f"if(_long >= {2 * step * WINDOWS}, least(_{j}, _{j + step}), _{j})")  # noqa: B023
        span = f"if(_long >= {2 * step * WINDOWS}, {2 * step}, {span})"
        step *= 2
    windows = f"cast(greatest(0, least({BLOCK}, _left - {span} + 1)) as int)"
    marks = f"case when _m >= {CHARS} then slice(array({', '.join(f'_{j}' for j in range(BLOCK))}), 1, {windows}) when _m > 0 then array(_whole) else cast(array() as array<bigint>) end"
    return t.selectExpr(*keep[: -len(("_m", "_long", "_at", "_next", "_left", "_whole"))], f"array_distinct({marks}) as _marks")


def joined(which: Column) -> Column:
    """Aggregate: the marks of the blocks where `which` holds, in the order of the text."""
    return F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.when(which, F.struct("_block", "_marks")))).getField("_marks")))


def with_char_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the array of marks of column `text`, over its code points, as column `out`; rows keep their order."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), F.col(text).alias("_text"))
    found = block_marks(rows, "_text", once=("_all",)).groupBy("_row").agg(F.first("_all", ignorenulls=True).alias("_all"), joined(F.lit(True)).alias("_marks"))
    return found.orderBy("_row").select("_all.*", F.col("_marks").alias(out))


def edited_marks(kept: Column, size: Column, full: int) -> Column:
    """The marks of a text of `size` code points: `kept` of one with `marks`, then the first of one with `next_marks`.

    `join` are the marks of its `full` code points on either side, `end` of its last `full`; a
    full window has that many.  The place of the least never goes back from one window to the
    next, so before the first of `join` lie the choices of all windows before, and so on.
    """
    last = (1 << POSITION_BITS) - 1

    def moved(marks: str, by: Column) -> Column:  # positions count down
        return F.transform(marks, lambda m: m - by)

    def place(m: Column) -> Column:
        return m.bitwiseAND(F.lit(last))

    first, end = moved("join", kept - full), moved("end", size - full)
    before = F.transform(F.array(place(F.element_at("join", 1)) - (kept - full)), lambda c: F.filter("marks", lambda m: place(m) > c))
    bounds = F.struct((place(F.element_at("join", -1)) + full).alias("hi"), (place(F.element_at("end", 1)) - (size - kept - full)).alias("lo"))
    between = F.transform(F.array(bounds), lambda c: F.transform(F.filter("next_marks", lambda m: (place(m) < c["hi"]) & (place(m) > c["lo"])), lambda m: m - kept))
    return F.array_distinct(F.flatten(F.concat(before, F.array(first), between, F.array(end))))


def as_text(marks: str) -> Column:
    return F.array_join(F.transform(F.col(marks), lambda m: F.lower(F.hex(m))), " ")


def hashes(marks: str) -> Column:
    return F.array_distinct(F.transform(F.col(marks), lambda m: F.shiftright(m, POSITION_BITS)))


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def followers(rows: DataFrame) -> DataFrame:
    """The first row of the next bucket in use, for each bucket; the first of all after the last."""
    firsts = rows.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("first")).withColumn("super", F.floor(F.col("bucket") / SUPER))
    inside = firsts.withColumn("next", F.lead("first").over(Window.partitionBy("super").orderBy("bucket")))
    tops = firsts.groupBy("super").agg(F.min("first").alias("top"))
    everything = Window.partitionBy(F.lit(0)).orderBy("super")  # one row for each SUPER * BUCKET ids
    tops = tops.withColumn("after", F.coalesce(F.lead("top").over(everything), F.first("top").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    link = inside.join(tops.select("super", "after"), "super").select(F.coalesce("next", "after").alias("doc_id"), F.col("bucket").alias("into"))
    link = F.broadcast(link) if firsts.count() <= MAX_BROADCAST else link  # one row for each bucket in use
    return rows.drop("bucket").join(link, "doc_id").groupBy("into", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("into").alias("bucket"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the columns of the contract."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lost = -1 - F.pmod(F.xxhash64("text"), F.lit(4096))  # rows without id, away from the others
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNotNull(), F.floor(F.col("doc_id") / BUCKET)).otherwise(lost))
    all_rows = rows.withColumn("guest", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))).unionByName(followers(rows).withColumn("guest", F.lit(1)))
    tasks = table_bytes(docs) // TASK_BYTES
    dealt = all_rows.repartition(tasks, "bucket") if tasks > parts(docs.sparkSession) else all_rows.repartition("bucket")
    w = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    t = dealt.withColumn("place", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    t = t.withColumn("next", F.when(F.col("guest") < 0, "").otherwise(F.col("next"))).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    t = t.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring(F.col("next"), F.lit(1), F.col("half"))))
    t = t.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("n_next", F.least(F.col("half").cast("long"), F.char_length("next").cast("long")))
    # where all texts are long, only windows at the join and the last one are new; the others are the text's and its successor's
    full = CHARS + SPAN - 1
    least = SPAN * WINDOWS + CHARS - 1
    t = t.withColumn("long", (F.col("n_chars") >= least) & (F.char_length("next") >= least) & (F.col("n_chars") + F.col("n_next") < 1 << POSITION_BITS))
    kept = F.col("n_chars") - F.col("half")
    join = F.substring(F.col("edited"), (kept - full + 1).cast("int"), F.lit(2 * full))
    end = F.substring(F.col("edited"), (kept + F.col("n_next") - full + 1).cast("int"), F.lit(full))
    texts = F.array(F.col("text"), F.when(~F.col("long"), F.col("edited")), F.when(F.col("long"), join), F.when(F.col("long"), end))
    t = t.select("bucket", "place", "guest", "doc_id", "n_chars", "half", "n_next", "long", "edited_sha256", F.posexplode(texts).alias("edit", "text"))
    t = block_marks(t.where("text is not null and (guest < 1 or edit = 0)"), "text", once=("edited_sha256",), part="edit > 1")
    t = t.groupBy("bucket", "place").agg(
        *[F.max(c).alias(c) for c in ("guest", "doc_id", "n_chars", "half", "n_next", "long", "edited_sha256")], *[joined(F.col("edit") == i).alias(c) for i, c in enumerate(("marks", "direct", "join", "end"))]
    )
    t = t.withColumn("next_marks", F.lead("marks").over(Window.partitionBy("bucket").orderBy("place")))
    t = t.withColumn("edited_marks", F.when(F.col("long"), edited_marks(kept, kept + F.col("n_next"), full)).otherwise(F.col("direct")))
    t = t.withColumn("h", hashes("marks")).withColumn("he", hashes("edited_marks"))
    after = F.when(F.col("guest") == 0, F.lead("h").over(Window.partitionBy("bucket").orderBy("place")))
    t = t.withColumn("hn", F.coalesce(after, F.array().cast("array<bigint>"))).where("guest < 1")
    return t.select(
        "doc_id", "n_chars", "edited_sha256", as_text("marks").alias("fingerprint"), as_text("edited_marks").alias("edited_fingerprint"), likeness("h", "he").alias("near_edited"), likeness("h", "hn").alias("near_next")
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
