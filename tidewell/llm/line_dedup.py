"""Line deduplication by a deletion-neighbourhood join. DataFrame operations only.

A line is a run of text between line feeds, lower-cased, with its ASCII white space trimmed and collapsed. Its units are its
words if it has ``exact_words`` or more; else, if it has ``characters`` or more characters, these (a line of Chinese or
Japanese is one word or two). Lines with fewer of both always stay: so short a line repeats by chance. An equal line is dropped
wherever an earlier one stands, earliest meaning smallest ``(doc_id, line number)``. Lines of ``near_words`` words or more,
and all lines of characters, are also dropped when an earlier line is within an edit distance of one unit (inserted, deleted or
replaced).

Two lines within one edit share their first or their last ``c`` units, where ``2 c`` is at most the length of the shorter one.
So first only those ends are hashed, and lines that share one with a different line go on. Of these, every variant with one unit
of the rest deleted becomes a hashed key; a replaced unit leaves equal variants with a gap at one place, an inserted
one leaves a variant equal to the shorter line. A variant's key comes from running sums over the hashes of its units, so a
line costs time in proportion to its length. Equal keys meet in an aggregation that finds the earliest line, and the edit
distance of the two lines is then verified on their units.

Equal lines are first reduced to their earliest occurrence, and every group is reduced by a minimum that is taken before the
shuffle. A line that makes up a thousandth of all or more, of which there are a thousand at most, is looked up by broadcast and
not by a join, so no task gets all its copies. A null text stays null, an empty one empty. Rows
that repeat a doc_id are one document for the order of lines; their equal lines count as the same occurrence and stay. An
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bitmap, drop, is_set, join_spread, stash, unused

EXACT_WORDS, NEAR_WORDS, CHARACTERS = 5, 8, 20
_GAP = r"\x20*[\t\x0B\f\r][\t\x0B\f\r\x20]*|\x20{2,}"
_SCAN = 128
MOST_BITS = 1 << 26  # 8 MB


def lines_of(text: Column) -> Column:
    """The lines of a text, lower-cased, without white space at their ends and with single spaces inside."""
    low, untidy = F.lower(text), F.lit(False)
    for mark in ("  ", "\t", "\x0b", "\f", "\r"):  # most texts have none, and searching is cheaper than replacing
        untidy = untidy | F.contains(text, F.lit(mark))
    return F.split(F.when(untidy, F.regexp_replace(low, _GAP, " ")).otherwise(low), "\n", -1)


def _units(line: Column, by_word: Column) -> Column:
    return F.when(by_word, F.split(line, " ")).otherwise(F.split(line, ""))


def _lines(documents: DataFrame, exact_words: int, characters: int) -> DataFrame:
    """``doc_id, pos, line, by_word, n`` (number of units) of the lines that take part."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(lines_of(F.col("text").cast("string"))).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line"))
    rows = rows.withColumn("n_words", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    by_word, length = F.col("n_words") >= exact_words, F.char_length("line")
    rows = rows.where(by_word | (length >= characters)).withColumn("by_word", by_word)
    return rows.withColumn("n", F.when(F.col("by_word"), F.col("n_words")).otherwise(length))


def _cut(n: str) -> str:
    return f"(({n}) div 4) * 2"


def _ends(n: str) -> list[Column]:
    """Hashes of the first and the last units that lines of ``n`` and ``n + 1`` units share when their edit is elsewhere."""
    c = f"cast({_cut(n)} as int)"
    head = f"if(by_word, substring_index(line, ' ', {c}), left(line, {c}))"
    tail = f"if(by_word, substring_index(line, ' ', -{c}), right(line, {c}))"
    return [F.expr(f"xxhash64({k}, by_word, {c}, {part})") for k, part in enumerate((head, tail))]


def dropped_lines(documents: DataFrame, exact_words: int = EXACT_WORDS, near_words: int = NEAR_WORDS, characters: int = CHARACTERS) -> DataFrame:
    """Columns ``doc_id, pos``: every line that an earlier equal or near line makes redundant; ``pos`` counts from 0."""
    rows = _lines(documents, exact_words, characters)
    near = ~F.col("by_word") | (F.col("n") >= near_words)
    two = near & (F.col("n") % 4 == 0)  # the cut for partners that are one unit shorter is another
    ends = [F.when(near, x) for x in _ends("n")] + [F.when(two, x) for x in _ends("n - 1")]
    rows = stash(rows.select("doc_id", "pos", F.xxhash64("line").alias("h"), "by_word", "n", *[x.alias(f"e{k}") for k, x in enumerate(ends)]), "lines")
    given = ["by_word", "n", "e0", "e1", "e2", "e3"]
    first = stash(rows.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in given]), "first-lines")

    near_h = _near(documents, first, exact_words, characters)
    fate = stash(first.select("h", "first", "copies").join(near_h.withColumn("near", F.lit(True)), "h", "left").where("near or copies > 1"), "fates")
    drop(first, near_h)
    told = join_spread(rows.select("doc_id", "pos", "h"), fate, ["h"], "copies", rows.count())
    out = stash(told.where("near or first <> struct(doc_id, pos)").select("doc_id", "pos"), "dropped")
    drop(rows, fate)
    return out


def _near(documents: DataFrame, first: DataFrame, exact_words: int, characters: int) -> DataFrame:
    """Column ``h``: the different lines that have an earlier one within an edit."""
    # an end that two different lines share
    ends = F.array(*[F.struct(F.col(f"e{k}").alias("end"), F.lit(k % 2).alias("side"), F.lit(k < 2).alias("own")) for k in range(4)])
    offered = first.where("e0 is not null").select("h", F.explode(ends).alias("e")).select("h", "e.*").where("end is not null")
    live = offered.groupBy("end").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("end")
    chosen = stash(offered.join(live, "end"), "line-ends")
    lines = first.select("h", "first", "by_word", "n").join(chosen.select("h").distinct(), "h")
    lines = stash(lines, "ended-lines")
    # their texts: a bitmap of the lines' hashes, of a bounded size, keeps most others from the shuffle
    size = 64 * max(1, min(MOST_BITS, 16 * lines.count()) // 64)
    spot = F.pmod("h", F.lit(size))
    marks = stash(bitmap(lines.select(spot.alias("spot")), size // 64), "line-marks")
    texts = documents.select(F.explode(lines_of(F.col("text").cast("string"))).alias("line")).select(F.trim("line").alias("line"))
    texts = texts.withColumns({"h": F.xxhash64("line"), "marks": marks.scalar()}).where(is_set(F.col("marks"), spot)).groupBy("h").agg(F.first("line").alias("line"))
    told = stash(lines.join(texts, "h").select("h", "first", "by_word", "n", _units(F.col("line"), F.col("by_word")).alias("units")), "line-units")
    drop(marks)

    # without ``own`` an end is one that shorter partners have
    cut = F.expr(f"cast(if(own, {_cut('n')}, {_cut('n - 1')}) as int)")
    rest = F.when(F.col("side") == 0, F.slice("units", cut + 1, F.col("n"))).otherwise(F.slice("units", F.lit(1), F.col("n") - cut))
    # lines of n units have the same cut as those of n - 1 but where n is divisible by 4
    longer = ~F.col("own") | (F.col("n") % 4 != 0)
    shown = chosen.join(told, "h").select("h", "first", "end", "own", longer.alias("longer"), rest.alias("rest"))
    variants = stash(_variants(shown), "variants")
    seen = variants.groupBy("key").agg(
        F.min(F.when(F.col("longer"), F.struct("first", "h"))).alias("long"), F.min(F.when(~F.col("longer"), F.struct("first", "h"))).alias("short"),
        F.min("h").alias("x"), F.max("h").alias("y"),
    ).where("x <> y").select("key", "long", "short")
    # a longer line is held against the shorter one; a shorter one against the longer and, over a gap, its equals
    others = F.array("short", F.when(~F.col("longer"), F.col("long")))
    met = variants.join(seen, "key").select("h", "first", F.explode(others).alias("other"))
    met = met.where("other is not null and other.first < first").select("h", F.col("other.h").alias("other")).distinct()
    words = told.select("h", "units")
    pairs = met.join(words, "h").join(words.select(F.col("h").alias("other"), F.col("units").alias("earlier")), "other")
    near_h = stash(pairs.where(within_one(F.col("units"), F.col("earlier"))).select("h").distinct(), "near-lines")
    drop(chosen, lines, told, variants)
    return near_h


def _variants(shown: DataFrame) -> DataFrame:
    """``h, first, longer, key``: a row for each gap, for the whole rest, and for each deletion that a shorter partner may equal.

    A unit's hash is taken with its place, and a sequence's is the exclusive or over its units. What stands behind a deleted unit
    moves up by one place, so a deletion needs a running sum.
    """
    place = lambda shift: F.transform("rest", lambda u, i: F.xxhash64(i + shift, u))
    xor = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x))
    rows = shown.withColumns({"at": place(1), "moved": place(0)})
    rows = rows.withColumns({"whole": xor(F.col("at")), "all_moved": xor(F.col("moved"))})
    rows = rows.withColumn("inside", _blocks(F.zip_with("at", "moved", lambda a, m: a.bitwiseXOR(m))))
    ahead = _running("inside", F.col("all_moved"))  # units before a place as they stand, units from it on as moved
    key = lambda family, value: F.xxhash64(F.col("end"), F.lit(family), value)
    entry = lambda longer, key: F.struct(F.lit(longer).alias("longer"), key.alias("key"))
    gaps = F.transform("at", lambda x, i: entry(False, F.xxhash64(F.col("end"), F.lit(0), i, F.col("whole").bitwiseXOR(x))))
    whole = F.array(entry(False, key(1, F.col("whole"))))
    gone = F.array_distinct(F.zip_with(ahead, F.col("moved"), lambda a, m: key(1, a.bitwiseXOR(m))))  # of longs: by hash
    gone = F.transform(gone, lambda k: entry(True, k))
    none = F.array().cast("array<struct<longer:boolean,key:bigint>>")
    keys = F.concat(F.when(F.col("own"), F.concat(gaps, whole)).otherwise(none), F.when(F.col("longer"), gone).otherwise(none))
    return rows.select("h", "first", F.explode(keys).alias("k")).select("h", "first", "k.*")


def _onward(t: Column, x: Column) -> Column:
    return F.array_append(t, F.element_at(t, F.lit(-1)).bitwiseXOR(x))


def _blocks(array: Column) -> Column:
    """For each block of ``array`` the exclusive or of its first 0, 1, 2 ... elements."""
    last = F.greatest(F.lit(0), F.floor((F.size(array) - 1) / _SCAN).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(array, b * _SCAN + 1, F.lit(_SCAN)))
    return F.transform(parts, lambda p: F.aggregate(p, F.array(F.lit(0).cast("long")), _onward))


def _running(blocks: str, start: Column) -> Column:
    """``start`` and the exclusive or of all elements before each place."""
    bases = F.aggregate(blocks, F.array(start), lambda t, p: _onward(t, F.element_at(p, F.lit(-1))))
    pairs = F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda p, b: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x.bitwiseXOR(b)))
    return F.flatten(pairs)


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays are within one insertion, deletion or replacement: common ends cover all but one element."""
    same_from = lambda x, y: F.array_position(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: ~F.coalesce(p["x"] == p["y"], F.lit(False))), F.lit(True))
    longest = F.greatest(F.size(a), F.size(b))
    head, tail = same_from(a, b), same_from(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & ((head == 0) | ((head - 1) + (tail - 1) >= longest - 1))


def dedup_lines(documents: DataFrame, exact_words: int = EXACT_WORDS, near_words: int = NEAR_WORDS, characters: int = CHARACTERS) -> DataFrame:
    """The rows of ``documents`` with their redundant lines taken out of ``text``, and ``n_lines, n_dropped, kept_share`` set.

    ``kept_share`` is the part of the text's bytes that stays, 1 for null and empty texts.
    """
    doc, out, old = (unused(documents, n) for n in ("_doc", "_gone", "_old"))
    gone = dropped_lines(documents, exact_words, near_words, characters).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("pos").alias(out))
    rows = documents.join(gone, documents["doc_id"] == gone[doc], "left")
    lines, some = F.split("text", "\n", -1), F.col(out).isNotNull()
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(out), i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    rows = rows.withColumns({"n_lines": n, "n_dropped": F.when(some, F.size(out)).otherwise(0).cast("long"), old: F.octet_length("text")})
    rows = rows.withColumn("text", F.when(some, kept).otherwise(F.col("text")))
    share = F.when(F.col(old) > 0, F.octet_length("text") / F.col(old)).otherwise(1.0)
    return rows.withColumn("kept_share", share).drop(doc, out, old)
