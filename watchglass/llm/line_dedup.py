"""Removing lines that repeat, or nearly repeat, an earlier line.

An exact set-similarity join with built-in functions only. A line's tokens are its
distinct words in lower case. Lines of equal token sets form a class. Two classes are
linked if the Jaccard similarity of their token sets is at least 4/5. A line goes if an
earlier line, in order of (doc_id, row, line number), is in its class or in a linked one.
Rows are numbered once, in a written table, so that documents which share a doc_id, or
have none, stay apart.

The join is the usual one of prefix, length and positional filters: tokens are ordered
by rarity, two sets can only be linked if one of the rarest tokens of the larger (a fifth)
is one of the rarest of the smaller (a ninth), their sizes must be close, the tokens left
behind a common one must suffice, and the parities of their tokens in 128 groups may differ
in few groups only. Tokens are compared as 58-bit hashes behind a rarity level of 6 bits.

The classes that share a prefix token are joined with each other by that token and by a
band of sizes, each BAND times the one below: the larger set of a pair stands in its own
band, the smaller in those of all sizes that its place of the token leaves. What comes out
are the classes of pairs that pass all filters, which alone are worth a comparison of their
sets; these meet in the same way, by token and band. Where more than BLOCK classes meet they
are dealt to parts and nothing is emitted per pair: candidates come out of a semi-join, and
of their sets each pair of blocks is compared inside one row, out of which comes a row per
class. So a large group of near copies costs comparisons, in bounded memory and on many
tasks, but no rows. Each link is found under the first token
that both prefixes share, and counts once for either class. Tokens are dealt to PASSES
passes by their hash, one pass after the other, so that a share of the joins' rows is on
disk at a time; tokens do not meet each other, so the passes miss nothing.

Defined results: a null text has no lines; a line without words is never removed and
has no class; rows of equal doc_id are ordered by their numbers, which follow the input's
partitions; a null doc_id comes before all others. An empty table gives no row. Columns
other than those named keep their values, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, free_name, tasks, written

NUM, DEN = 4, 5  # the similarity from which lines are linked, as a fraction
BUCKETS = 1 << 16  # of the table of token counts that orders tokens by rarity
NO_ID = -(1 << 63)
BLOCK = 1024  # classes of a token and band that are joined, and those of a larger group in one part
BAND = 1.15  # the sizes of a band of sets, the largest by the smallest
PASSES = 4  # over the tokens, whose rows are shuffled one pass after the other
SPACE = "\t\r\x0b\x0c"


def spaced(text: Column) -> Column:
    """`text` with a space for each of SPACE; one that has none of them is not gone through by character."""
    odd = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in SPACE))
    return F.when(odd, F.translate(text, SPACE, " " * len(SPACE))).otherwise(text)


def words(line: Column) -> Column:
    """Words between white space, in lower case; may hold empty texts."""
    return F.split(F.lower(spaced(line)), " ")


def split_lines(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, row, content, line_no, line: a row per line; a null doc_id is NO_ID here, content a hash of the text."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), number.alias("row"),
        F.xxhash64(F.col(text)).alias("content"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"),
    )


def rarity(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> Column:
    """A table of levels by token bucket: the binary logarithm of what is in the bucket.

    The counts are over all words; their number is fixed, whatever the data, so they
    may pass through the driver and into the plan as a constant.
    """
    counted = (
        docs.select(F.explode(words(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))).alias("w")).where("w != ''")
        .groupBy(F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int").alias("b"))
        .count()
        .collect()
    )
    levels = [0] * buckets
    for b, n in counted:
        levels[b] = n.bit_length()
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")


def ranks(line: Column, levels: Column, buckets: int = BUCKETS) -> Column:
    """The distinct tokens of a line as numbers whose order is that of rarity."""
    def rank(h: Column) -> Column:
        level = F.get(levels, F.pmod(h, F.lit(buckets)).cast("int"))
        return F.shiftleft(level, 58).bitwiseOR(F.shiftrightunsigned(h, 6))

    # A word is hashed once, and ranked once for a line.
    hashed = F.array_remove(F.transform(words(line), lambda word: F.xxhash64(word)), F.xxhash64(F.lit("")))
    return F.sort_array(F.array_distinct(F.transform(F.array_distinct(hashed), rank)))


def parity(tokens: Column) -> list[Column]:
    """Of 128 groups of tokens, whether a line has an odd number of each, in two numbers.

    Sets that differ in d tokens differ in d groups at most.
    """
    def flip(half: int):
        def apply(s: Column, r: Column) -> Column:
            mine = F.shiftrightunsigned(r, 6).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit(1 - half))
            return s.bitwiseXOR(F.call_function("shiftleft", mine.cast("long"), r.bitwiseAND(F.lit(63)).cast("int")))

        return apply

    return [F.aggregate(tokens, F.lit(0).cast("long"), flip(half)) for half in range(2)]


def prefix_size(n: Column) -> Column:
    """n - ceil(n * NUM / DEN) + 1"""
    return (n - F.floor((n * NUM + DEN - 1) / DEN) + 1).cast("int")


def index_size(n: Column) -> Column:
    """n - ceil(n * 2 * NUM / (NUM + DEN)) + 1: rarest tokens of a set that a larger one's prefix must meet."""
    return (n - F.floor((n * 2 * NUM + NUM + DEN - 1) / (NUM + DEN)) + 1).cast("int")


def _enough(overlap: Column, n: Column, m: Column) -> Column:
    """Whether so many common tokens make the similarity NUM/DEN."""
    return overlap * (NUM + DEN) >= (n + m) * NUM


def _least_overlap(n: Column, m: Column) -> Column:
    return F.floor(((n + m) * NUM + NUM + DEN - 1) / (NUM + DEN)).cast("int")


def _band(n: Column) -> Column:
    """The band of a size."""
    return F.floor(F.log(n) / math.log(BAND)).cast("int")


def _meet(token: Column, band: Column) -> Column:
    """A number for a token in a band, which gives back the token: sets are joined by it alone."""
    return token.bitwiseXOR(F.xxhash64(band))


def _most(n: Column, pos: Column) -> Column:
    """The largest set that a set of `n` tokens can be linked with if `pos` is the place of their first common one."""
    return F.floor((n * DEN - pos * (NUM + DEN)) / NUM)


def _blocks(rows: DataFrame, *members: str) -> DataFrame:
    """A row per meet and pair of blocks, with the array `g` of its members.

    `rows` have `meet`, a key, and `parts`, the blocks there. Each member goes to every pair of
    blocks with its own, `c`.
    """
    large = rows.withColumn("c", F.pmod(F.col("key"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    pair = [F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j")]
    return (
        large.select("*", *pair)
        .repartition(tasks(rows.sparkSession), "meet", "i", "j")
        .groupBy("meet", "i", "j")
        .agg(F.collect_list(F.struct(*members, "c")).alias("g"))
        .select("g", (F.col("i") == F.col("j")).alias("same"))
    )


def _large(rows: DataFrame, name: str) -> DataFrame | None:
    """meet, token, band, parts: where more than BLOCK of `rows` meet, and to how many parts they go; None if nowhere.

    Written, so that Spark knows its size: it is broadcast if it is small enough.
    """
    counted = rows.groupBy("token", "band").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    large = written(
        counted.select(
            _meet(F.col("token"), F.col("band")).alias("meet"), "token", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")
        ),
        name,
    )
    if not large.isEmpty():
        return large
    discard(large)
    return None


def _pass(rows: DataFrame, k: int) -> DataFrame:
    """The rows whose token is dealt to pass `k`."""
    return rows.where(F.pmod("token", F.lit(PASSES)) == k)


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{side}_{c}" for c in rows.columns})


def _met(x: DataFrame, y: DataFrame, passes: Column) -> DataFrame:
    """Pairs that meet and pass: of larger sets with columns x_*, smaller ones with columns y_*."""
    return _sided(x, "x").hint("merge").join(_sided(y, "y"), (F.col("x_meet") == F.col("y_meet")) & passes)


def _having(rows: DataFrame, others: DataFrame, passes: Column, side: str, other: str) -> DataFrame:
    """token, band, key: those of `rows` that have a partner among `others`; both have `parts` where they meet.

    `rows` are dealt to the parts, the others go to each; no pair leaves the join, which ends for a row at its first partner.
    """
    dealt = _sided(rows.withColumn("part", F.pmod("key", F.col("parts")).cast("int")), side)
    every = _sided(others.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), other)
    same = (F.col("x_meet") == F.col("y_meet")) & (F.col("x_part") == F.col("y_part"))
    return dealt.hint("merge").join(every, same & passes, "left_semi").select(
        *(F.col(f"{side}_{c}").alias(c) for c in ("token", "band", "key"))
    )


def _larger_is(x, y, n: Column, m: Column) -> Column:
    return (m < n) | ((m == n) & (y("key") < x("key")))


def _passes(x, y, n: Column, m: Column) -> Column:
    """The filters for sets of `n` and `m` tokens, whose columns are x(name) and y(name): lengths, parities, the token before.

    Sets that share the token before as well meet there, or before that.
    """
    differ = sum(F.bit_count(x(p).bitwiseXOR(y(p))).cast("int") for p in ("even", "odd"))
    return (
        (m * DEN >= n * NUM) & (n * DEN >= m * NUM) & (differ <= n + m - _least_overlap(n, m) * 2)
        & ~F.coalesce(x("prev") == y("prev"), F.lit(False))
    )


def _of(side: str):
    return lambda name: F.col(f"{side}_{name}")


def _rows(postings: DataFrame, band: Column) -> DataFrame:
    """What of `postings` is joined, in few and short columns; `at` has the size and the place of the token."""
    at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    placed = postings.withColumn("band", band)
    return placed.select(_meet(F.col("token"), F.col("band")).alias("meet"), "key", at.alias("at"), "even", "odd", "prev")


def _larger(postings: DataFrame) -> DataFrame:
    """`postings` in the band of their size."""
    return _rows(postings, _band(F.col("n")))


def _smaller(postings: DataFrame) -> DataFrame:
    """`postings` that can be the smaller set of a link, in each band of the larger."""
    bands = F.sequence(_band(F.col("n")), _band(_most(F.col("n"), F.col("pos"))))
    return _rows(postings.where("pos < short"), F.explode(bands))


def _candidates(postings: DataFrame, large: DataFrame | None) -> DataFrame:
    """token, band, key: classes that the filters leave with a partner there."""
    x, y = _of("x"), _of("y")
    n, m = (F.shiftright(side("at"), 32).cast("int") for side in (x, y))
    i, j = (side("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") for side in (x, y))
    behind = F.least(n - i, m - j) >= _least_overlap(n, m)
    passes = _larger_is(x, y, n, m) & _passes(x, y, n, m) & behind
    band = _band(n)
    larger, smaller = _larger(postings), _smaller(postings)
    few = [rows if large is None else rows.join(large.select("meet"), "meet", "left_anti") for rows in (larger, smaller)]
    found = _met(*few, passes).select(
        _meet(x("meet"), band).alias("token"), band.alias("band"), F.explode(F.array("x_key", "y_key")).alias("key")
    )
    if large is None:
        return found
    larger, smaller = (rows.join(large, "meet") for rows in (larger, smaller))
    return found.unionByName(_having(larger, smaller, passes, "x", "y")).unionByName(
        _having(smaller, larger, passes, "y", "x")
    )


def _links(found: DataFrame, large: DataFrame | None) -> DataFrame:
    """key, n_links, earlier: verified links of each class; whether one is to an earlier class.

    `found` are candidates with their sets. Two classes are compared under the first token that
    their prefixes share, in the band of the larger, and nowhere else, so each link counts once
    for either class.
    """
    place = F.array_position("ranks", F.col("token")).cast("int")
    rows = found.withColumn("place", place).where("place > 0").select(
        _meet(F.col("token"), F.col("band")).alias("meet"), "key", "first", "ranks", "n", "even", "odd",
        (F.col("band") == _band(F.col("n"))).alias("own"), F.slice("ranks", F.lit(1), F.col("place") - 1).alias("before"),
        F.get("ranks", F.col("place") - 2).alias("prev"),
    )
    x, y = _of("x"), _of("y")
    n, m = x("n"), y("n")
    linked = (
        x("own") & _larger_is(x, y, n, m) & _passes(x, y, n, m) & ~F.arrays_overlap(x("before"), y("before"))
        & _enough(F.size(F.array_intersect(x("ranks"), y("ranks"))), n, m)
    )
    few = rows if large is None else rows.join(large.select("meet"), "meet", "left_anti")
    met = _met(few, few, linked)

    def side(own: str, other: str) -> Column:
        earlier = (F.col(f"{other}_first") < F.col(f"{own}_first")).cast("int")
        return F.struct(F.col(f"{own}_key").alias("key"), F.lit(1).cast("long").alias("links"), earlier.alias("earlier"))

    counted = met.select(F.explode(F.array(side("x", "y"), side("y", "x"))).alias("r")).select("r.*")
    if large is not None:
        counted = counted.unionByName(_links_inside(rows.join(large.select("meet", "parts"), "meet")))
    return counted.groupBy("key").agg(F.sum("links").alias("n_links"), F.max("earlier").cast("boolean").alias("earlier"))


def _links_inside(rows: DataFrame) -> DataFrame:
    """key, links, earlier: the same for those that meet in `parts`, a pair of blocks in a row, where no pair gets a row.

    Sets are compared by what they differ in from one of them: of its tokens those that they miss, and
    their others. Two sets share its tokens without those that either misses, and what both differ in.
    """
    plain = ("key", "first", "n", "even", "odd", "own", "before", "prev")
    pivot = F.get("g", F.lit(0))["ranks"]
    slim = F.transform("g", lambda x: F.struct(
        *(x[c].alias(c) for c in (*plain, "c")), F.size(F.array_except("pivot", x["ranks"])).alias("missed"),
        F.concat(F.array_except("pivot", x["ranks"]), F.array_except(x["ranks"], F.col("pivot"))).alias("apart"),
    ))
    grouped = _blocks(rows, *plain, "ranks").withColumn("pivot", pivot).select(
        "same", F.size("pivot").alias("size"), slim.alias("g")
    )

    def linked(x: Column, y: Column) -> Column:
        n, m = x["n"], y["n"]
        here = F.when(_larger_is(x.__getitem__, y.__getitem__, n, m), x["own"]).otherwise(y["own"])
        common = F.col("size") - x["missed"] - y["missed"]
        more = F.size(F.array_intersect(x["apart"], y["apart"]))
        return (
            (x["key"] != y["key"]) & (F.col("same") | (x["c"] != y["c"])) & here
            & _passes(x.__getitem__, y.__getitem__, n, m) & ~F.arrays_overlap(x["before"], y["before"])
            & (_enough(common, n, m) | _enough(common + more, n, m))
        )

    partners = F.transform("g", lambda x: F.struct(
        x["key"].alias("key"),
        F.transform(F.filter("g", lambda y: linked(x, y)), lambda y: (y["first"] < x["first"]).cast("int")).alias("partners"),
    ))
    found = grouped.select(F.explode(F.filter(partners, lambda r: F.size(r["partners"]) > 0)).alias("r"))
    return found.select(
        "r.key", F.size("r.partners").cast("long").alias("links"), F.array_max("r.partners").alias("earlier")
    )


def match_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line: doc_id, line_no, class_doc, class_line, copies, n_links, removed.

    class_doc and class_line are the first line of the class, copies its lines, n_links
    the classes linked to it.
    """
    return _matched(docs, text)[0].drop("row")


def _matched(docs: DataFrame, text: str, row: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """match_lines with `row`, which is the column of `docs` that `row` names, if any, and the tables it reads."""
    levels = rarity(docs, text)
    ranked = split_lines(docs, text, row).withColumn("ranks", ranks(F.col("line"), levels))
    n = F.size("ranks")

    def both(found: Column) -> list[Column]:
        return [p.alias(name) for p, name in zip(parity(found), ("even", "odd"))]

    slim = written(
        ranked.select(
            "doc_id", "row", "line_no", "content", n.alias("n"),
            F.when(n > 0, F.xxhash64("ranks", "ranks")).alias("key"),
            F.slice("ranks", F.lit(1), F.greatest(prefix_size(n), F.lit(1))).alias("prefix"),
            *both(F.col("ranks")),
        ),
        "lines",
    )
    place = F.struct("doc_id", "row", "line_no")
    classes = slim.where("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("doc_id", "row", "line_no", "content")).alias("first"), F.count("*").alias("copies"),
        F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"),
        F.any_value("even").alias("even"), F.any_value("odd").alias("odd"),
    )
    classes = written(classes, "line-classes")
    lines = written(slim.select("doc_id", "row", "line_no", "key"), "line-places")
    discard(slim)
    postings = classes.select(
        "key", "n", index_size(F.col("n")).alias("short"), "even", "odd", "prefix", F.posexplode("prefix").alias("pos", "token")
    ).withColumn("prev", F.get("prefix", F.col("pos") - 1)).drop("prefix")
    # Rare tokens need not be counted, as the level bounds the classes of a token.
    common = postings.where(F.shiftrightunsigned("token", 58) >= (BLOCK + 1).bit_length())
    large = _large(common.withColumn("band", _band(F.col("n"))), "line-common")
    candidates = [written(_candidates(_pass(postings, k), large).distinct(), "line-candidates") for k in range(PASSES)]
    if large is not None:
        discard(large)
    every = reduce(DataFrame.unionByName, candidates)

    keys = every.select("key").distinct()
    facts = written(classes.select("key", "first", "copies"), "line-facts")
    discard(classes)
    firsts = facts.join(keys, "key", "left_semi").select("key", "first")
    # The lines that are needed are picked inside a row of their document: rows of one doc_id
    # and one text have the same lines, so any of them will do.
    wanted = firsts.groupBy(F.col("first.doc_id").alias("id"), F.col("first.content").alias("content")).agg(
        F.collect_list(F.struct("key", "first")).alias("wanted")
    )
    source = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text)).alias("content"),
        F.col(text).alias("source"),
    )
    picked = source.join(wanted, ["id", "content"]).select(F.split("source", "\n").alias("lines"), "wanted").select(
        "lines", F.explode("wanted").alias("w")
    )
    line = F.get("lines", F.col("w.first.line_no"))
    first = F.struct("first.doc_id", "first.row", "first.line_no")
    tokens = picked.select("w.*", line.alias("line")).select("key", first.alias("first"), ranks(F.col("line"), levels).alias("ranks"))
    once = tokens.where(F.xxhash64("ranks", "ranks") == F.col("key")).dropDuplicates(["key"])
    sets = written(once.withColumn("n", F.size("ranks")).select("*", *both(F.col("ranks"))), "line-sets")
    large = _large(every, "line-common")
    links = written(_links(every.join(sets, "key"), large), "line-links")
    discard(*candidates, sets, *([] if large is None else [large]))
    found = lines.join(facts.join(links, "key", "left"), "key", "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "row", "line_no",
        F.nullif("first.doc_id", F.lit(NO_ID)).alias("class_doc"), F.col("first.line_no").alias("class_line"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("earlier") | (F.col("first").isNotNull() & (place > first)), F.lit(False)).alias("removed"),
    )
    return found, [lines, facts, links]


def drop_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the lines that repeat an earlier one; documents left without a word go.

    Other columns stay as they are, a column n_chars follows the text. A document that
    had no words to begin with stays.
    """
    row, gone_name, rest_name = (free_name(docs, c) for c in ("row_number", "lines_gone", "lines_left"))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")
    flags, read = _matched(rows, text, row)
    gone = written(
        flags.where("removed").groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone_name)), "lines-gone"
    )
    discard(*read)
    joined = rows.join(gone, row, "left")
    lost, left = F.col(gone_name), F.col(rest_name)
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(lost, i))
    rest = F.when(lost.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn(rest_name, rest).where(
        lost.isNull() | (F.trim(F.translate(rest_name, "\t\r\x0b\x0c\n", "     ")) != "")
    )
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(left.alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(lost.isNull(), F.col(c)).otherwise(F.length(left).cast(kind)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
