"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its lower-cased runs of anything but white space, as a set.  A line that has a
Jaccard similarity of 0.75 or more with an earlier line, of any document, goes.  Lines come in
the order of (doc_id, place in the text).  The steps:

1. Rarity: how often the tokens of each of CELLS hash cells occur.  A token's key is the class of its cell's
   count and its hash below it, so sorted keys are tokens from rare to common, and an order that all lines share.
2. Lines with equal sets become one, known by the first of them.
3. Prefix filter on couples, two tokens that are next to each other in a line's sorted keys.  Lines of nx and ny tokens that match have
   at least 3/7 (nx + ny) in common and at most 1/7 (nx + ny) apart.  Each token apart parts two common ones at most, so
   they share 2/7 (nx + ny) - 1 couples at least, the first of them among the first half of the longer line's couples and 3/7 of the shorter's.
   Few lines share two rare tokens, however large the table is.  Pairs must agree in length, reach the needed couples from the places of
   the shared one, and differ in no more parities than they may in tokens.
4. Couples travel as 64-bit hashes; equal hashes of different ones only add candidates.  They meet in ROUNDS, so that the shuffle of one is gone before the next.
   Of the earliest lines for its LEADS rarest tokens every line first meets the one with most parities in common.  Those that match are gone
   and no longer ask for an earlier one; only the others meet all lines with a shared couple.
5. Pairs are verified on the whole sets of 64-bit hashes, read again for the lines concerned: first the NEAREST ones of each line
   by parities, then all pairs of the lines that this leaves.  Copies therefore never make all their pairs.

Null texts stay null; lines without a token match nothing and stay; a text of which all lines go is
empty.  Rows with one doc_id come in the order of a hash of their texts; rows that are alike in both
are one document and get the same text.  Rows without id come first.  Other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import remove, save

BLANKS = "\t\x0b\f\r"
CELLS = 1 << 18
HASH_BITS = 57  # of a token's hash in its key, below six bits of the class
LEADS, NEAREST = 6, 4  # lines that a line meets before all others
ROUNDS = 4  # parts of the couples
LONG = 40  # tokens of a line above which it has a second word of parities, which gives them 128 cells
POS_BITS = 28  # a text has fewer lines than 2**28
BROADCAST_ROWS = 1_000_000  # of line numbers (16 bytes each); above it the join shuffles
AT = ("doc", "sub")  # what tells a line and orders all of them
MARKS = ("mark", "mark2")  # parities of all tokens in 64 cells, and of half of them if a line is LONG


def _cell(h: Column) -> Column:
    return h.bitwiseAND(CELLS - 1).cast("int")


def plain(text: Column) -> Column:
    """Lower-cased, with a space for every white space but the ends of lines."""
    low = spaced = F.lower(text)
    for blank in BLANKS:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.when(text.rlike(f"[{BLANKS}]"), spaced).otherwise(low)  # most texts have none of them


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, sub, line) of all lines of docs (doc, tie, text), as plain text."""
    lines = docs.select("doc", "tie", F.posexplode(F.split(plain(F.col("text")), "\n")).alias("pos", "line"))
    return lines.select("doc", F.shiftleft("tie", POS_BITS).bitwiseOR(F.col("pos").cast("long")).alias("sub"), "line")


def rarity(docs: DataFrame) -> Column:
    """For each cell the class of the number of tokens in it, half a power of two each: a constant of CELLS numbers."""
    every = docs.select(F.explode(F.split(F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("t")).filter("t <> ''")
    counts = every.groupBy(_cell(F.xxhash64("t")).alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # CELLS rows at most
    classes = np.zeros(CELLS, np.int64)
    classes[counts["cell"].to_numpy()] = np.minimum(2 * np.log2(counts["n"].to_numpy()), 63)
    return F.split(F.lit(",".join(map(str, classes.tolist()))), ",").cast("array<bigint>")


def tokens(lines: DataFrame) -> DataFrame:
    """lines (doc, sub) with h, the hashes of their tokens, each once; without lines that have none."""
    h = F.array_except(F.transform(F.split("line", " "), lambda t: F.xxhash64(t)), F.array(F.xxhash64(F.lit(""))))  # each token once
    return lines.filter(F.trim("line") != "").select(*AT, h.alias("h"))


def keyed(lines: DataFrame, classes: Column) -> DataFrame:
    """lines with keys, the sorted keys of their tokens, and n, how many; without lines that have none."""
    key = F.transform("h", lambda x: F.shiftleft(F.get(classes, _cell(x)), HASH_BITS).bitwiseOR(F.shiftrightunsigned(x, 64 - HASH_BITS)))
    return tokens(lines).select(*AT, F.sort_array(key).alias("keys")).withColumn("n", F.size("keys"))


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _couples(n: Column, shorter: bool = False) -> Column:
    """How many couples of n sorted tokens the first common one may be among, for the longer or the shorter line of a pair."""
    other = n if shorter else _ceil_div(3 * n, 4)
    return n - _ceil_div(2 * (n + other), 7) + 1


def _apart(x: str, y: str) -> Column:
    """In how many parities lines x and y differ: of 128 cells where both are LONG, else of 64."""
    m, m2 = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in MARKS)
    return F.when((F.col(f"{x}.n") > LONG) & (F.col(f"{y}.n") > LONG), F.bit_count(m.bitwiseXOR(m2)) + F.bit_count(m2)).otherwise(F.bit_count(m))


def _could(x: str, y: str, couples: bool = True) -> Column:
    """Whether lines x and y may match by lengths, parities, and, if they share a couple, the first one's places."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    near = (4 * nx >= 3 * ny) & (4 * ny >= 3 * nx) & (7 * _apart(x, y) <= nx + ny)
    return near & (7 * F.least(nx - F.col(f"{x}.i"), ny - F.col(f"{y}.i")) >= 2 * (nx + ny)) if couples else near


def _earlier(x: str, y: str) -> Column:
    """Whether line y comes before line x; no id comes before any."""
    a, b = F.col(f"{y}.doc"), F.col(f"{x}.doc")
    sub = F.col(f"{y}.sub") < F.col(f"{x}.sub")
    return F.coalesce((a < b) | ((a == b) & sub), F.when(a.isNull(), b.isNotNull() | sub), F.lit(False))


def _pairs(joined: DataFrame) -> DataFrame:
    """The pairs of joined lines, each once, and the parities in which they differ (apart)."""
    return joined.select(*(F.col(f"x.{c}").alias(c) for c in AT), *(F.col(f"y.{c}").alias(f"y_{c}") for c in AT), _apart("x", "y").alias("apart")).distinct()


def _met(asks: DataFrame, part: int) -> DataFrame:
    """The pairs of lines asks (with lead) that share a couple of a part and may match, the later ones of which ask."""
    n, i = F.col("n"), F.col("i")
    packed = F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(i.cast("long"), 2)).bitwiseOR(F.shiftleft((i < _couples(n, True)).cast("long"), 1)).bitwiseOR(F.col("asks").cast("long"))
    posted = asks.filter("n >= 3").select(*AT, *MARKS, "n", "asks", "lead", F.explode(F.sequence(F.lit(0), _couples(n) - 1)).alias("i"))
    posted = posted.withColumn("key", F.xxhash64(F.get("lead", i), F.get("lead", i + 1))).filter(F.pmod("key", F.lit(ROUNDS)) == part).select("key", *AT, *MARKS, packed.alias("packed"))
    # One shuffle serves both sides of the join; couples of one line, or of lines that ask nothing, go before it.
    same = Window.partitionBy("key")
    met = posted.withColumn("c", F.count(F.lit(1)).over(same)).withColumn("any", F.max(F.col("packed").bitwiseAND(1)).over(same)).filter("c > 1 AND any = 1")
    met = met.select("key", *AT, *MARKS, F.shiftright("packed", 32).cast("int").alias("n"), F.shiftright("packed", 2).bitwiseAND((1 << 30) - 1).cast("int").alias("i"), (F.col("packed").bitwiseAND(2) > 0).alias("index"), (F.col("packed").bitwiseAND(1) > 0).alias("asks"))
    nx, ny = F.col("x.n"), F.col("y.n")
    either = (F.col("x.index") & (nx <= ny)) | (F.col("y.index") & (ny <= nx))
    # The lines that ask are on the right, where a join holds all rows of a key.
    return _pairs(met.alias("y").join(met.filter("asks").alias("x"), (F.col("x.key") == F.col("y.key")) & either & _could("x", "y") & _earlier("x", "y")))


def _nearest(pairs: DataFrame, n: int) -> DataFrame:
    """Of each line the n pairs with the least parities apart."""
    order = Window.partitionBy(*AT).orderBy("apart", *(f"y_{c}" for c in AT))
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(*AT, *(f"y_{c}" for c in AT))


def _without(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows but for those of these lines."""
    return rows.join(lines, [rows[c].eqNullSafe(lines[c]) for c in AT], "left_anti")


def matched_lines(docs: DataFrame) -> DataFrame:
    """(doc, sub) of every line of docs (doc, tie, text) that an earlier line matches."""
    spark = docs.sparkSession
    n = F.col("n")
    lead = F.slice("keys", F.lit(1), _couples(n) + 1)

    def parity(counted: Callable) -> Column:
        """The parities, in 64 cells, of the tokens that are counted."""
        bit = lambda k: F.call_function("shiftleft", counted(k), k.bitwiseAND(63).cast("int"))
        return F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k)))

    upper = F.when(n > LONG, parity(lambda k: F.shiftright(k, 6).bitwiseAND(1))).otherwise(F.lit(0).cast("long"))
    marks = [parity(lambda k: F.lit(1).cast("long")).alias("mark"), upper.alias("mark2")]
    whole = save(keyed(lines_of(docs), rarity(docs)).select(*AT, "n", F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), F.transform(lead, lambda k: F.hash(k)).alias("lead"), *marks), "lines")
    rows = save(whole.select(*AT, "h1", "h2"), "line_sets")
    sets = whole.groupBy("h1", "h2").agg(F.min(F.struct(*AT, "n", *MARKS, "lead")).alias("s"), F.count(F.lit(1)).alias("copies"))
    sets = save(sets.select("h1", "h2", "copies", "s.*"), "sets")
    for path in {f.rsplit("/", 1)[0] for f in whole.inputFiles()}:
        remove(spark, path)

    first = sets.select(*AT, "n", *MARKS, F.explode(F.slice("lead", 1, LEADS)).alias("key"))
    earliest = first.groupBy("key").agg(F.min(F.struct(*AT, "n", *MARKS)).alias("s"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "s.*")
    leads = first.alias("x").join(earliest.alias("y"), F.col("x.key") == F.col("y.key")).filter(_could("x", "y", False) & _earlier("x", "y"))
    leads = save(_nearest(_pairs(leads), 1), "pairs")
    found = save(verified(leads, docs), "matched")
    # Lines already matched are still met, but no longer ask.
    asks = sets.join(found.withColumn("gone", F.lit(True)), [sets[c].eqNullSafe(found[c]) for c in AT], "left").select(*(sets[c] for c in AT), "n", *MARKS, "lead", F.col("gone").isNull().alias("asks"))
    asks = save(asks, "asks")
    more = save(_met(asks, 0), "pairs")
    for part in range(1, ROUNDS):
        more = more.union(save(_met(asks, part), "pairs"))
    more = save(more.distinct(), "pairs")
    near = save(verified(save(_nearest(more, NEAREST), "nearest"), docs), "matched")
    found = found.union(near)
    found = save(found.union(verified(save(_without(more, near), "pairs"), docs)), "matched")
    near = sets.join(found, [sets[c].eqNullSafe(found[c]) for c in AT], "left_semi").select("h1", "h2", F.lit(True).alias("near"))
    several = sets.filter("copies > 1").select("h1", "h2", *(F.col(c).alias(f"first_{c}") for c in AT))
    sets_gone = near.join(several, ["h1", "h2"], "full")
    later = F.struct(*AT) > F.struct(*(F.col(f"first_{c}") for c in AT))
    return rows.join(sets_gone, ["h1", "h2"]).filter(F.col("near") | later).select(*AT).distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, sub) of the pairs' later lines whose whole sets match the earlier ones'."""
    wanted = save(pairs.select(*AT).union(pairs.select(*(F.col(f"y_{c}").alias(c) for c in AT))).distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
        concerned = F.broadcast(wanted.select("doc").distinct())  # only texts of lines concerned are split
        docs = docs.join(concerned, docs["doc"].eqNullSafe(concerned["doc"]), "left_semi")
    lines = lines_of(docs)
    lines = lines.join(wanted, [lines[c].eqNullSafe(wanted[c]) for c in AT], "left_semi")
    sets = save(tokens(lines).select(F.struct(*AT).alias("at"), "h").dropDuplicates(["at"]), "whole")
    pairs = pairs.select(F.struct(*AT).alias("at"), F.struct(*(F.col(f"y_{c}").alias(c) for c in AT)).alias("before"))
    both = pairs.join(sets, "at").join(sets.select(F.col("at").alias("before"), F.col("h").alias("others")), "before")
    shared = F.size(F.array_intersect("h", "others"))
    return both.filter(4 * shared >= 3 * (F.size("h") + F.size("others") - shared)).select("at.*").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col shortened, and n_lines and n_removed, the lines before and taken away (0 for null texts).

    Columns of docs named n_lines or n_removed give way to these.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")))
    repeated = docs.groupBy(id_col).count().filter("count > 1").limit(1).count()
    text = F.col(text_col).cast("string")
    tie_of = lambda text: F.shiftrightunsigned(F.xxhash64(text), 64 - (63 - POS_BITS)) if repeated else F.lit(0).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), tie_of(text).alias("tie"), text.alias("text"))
    gone = matched_lines(source).groupBy("doc", F.shiftrightunsigned("sub", POS_BITS).alias("tie"))
    gone = gone.agg(F.collect_set(F.col("sub").bitwiseAND((1 << POS_BITS) - 1).cast("int")).alias("gone")).alias("g")
    # The columns of docs travel as one struct, so that none of their names can clash.
    whole = docs.select(F.struct(*docs.columns).alias("row")).alias("d")
    text, gone_at = F.col(f"d.row.`{text_col}`").cast("string"), F.col("g.gone")
    found = whole.join(gone, F.col(f"d.row.`{id_col}`").cast("long").eqNullSafe(F.col("g.doc")) & (tie_of(text) == F.col("g.tie")), "left")
    parts = F.split(text, "\n")
    kept = F.when(gone_at.isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone_at, i)), "\n"))
    own = [kept.alias(c) if c == text_col else F.col(f"d.row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*own, F.when(text.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.when(gone_at.isNull(), 0).otherwise(F.size(gone_at)).alias("n_removed"))
