"""Personal data by bootstrapped contextual extraction. DataFrame operations only.

Four kinds of identifiers are found by their form (email, ip, card, phone) and always count. Together with hexadecimal keys of 32 digits or more,
which are secrets only where their context says so, they are the seeds. What stands before a mention makes its
*lexical patterns*: the word before it, and the two words before it, lower-cased and with their punctuation; words end at white
space and behind ``=`` and ``:``. Other spans that look like identifiers (``MIN_DIGITS`` digits or more, no
seed) are candidates with patterns of their own: a token with six digits or more, or tokens with fewer that single spaces or dots
join, as in ``555 010 9988``. Patterns and instances make a bipartite graph that Spark scores in rounds:

* a pattern's confidence is the sum of the scores of the distinct instances it introduces, over their number and the number of
  places in all texts where anything else follows it; it needs ``support`` instances. Its kind is
  the one that most of these instances have (ties: the kind listed first);
* an instance's score is 1 for seeds, else the best confidence among its patterns of at least ``confidence``; its kind is that of
  the seed, else of its best pattern, so a pattern without a seed of its own gets a kind from lifted instances.

After ``rounds`` rounds the mentions that a confident pattern introduces (candidates and keys) are personal data of the pattern's kind,
of the most confident one's where there are two. They are added to the spans by form.

Positions are code points, ends exclusive. Spark has no function for the places of all matches, so a text is split by the
pattern and its gaps and matches are laid out again; expressions are written so that the matcher needs no recursion. Cards
are found after single separators between digits are swapped for a private character, which keeps all positions.

A null or empty text has no spans. Repeated rows are judged one by one, equal texts alike. A mention whose two words and span begin more
than ``WINDOW`` characters apart has only the patterns that fit. Groups (a pattern that a third of
the rows use, a value that all repeat) are aggregated before the shuffle, and hot ones are looked up by broadcast; no list of mentions is gathered for a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import drop, join_spread, stash

KINDS = ("email", "ip", "card", "phone", "secret")
_BASE = 4  # kinds by form
MIN_DIGITS = 4
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_JOINT = "\ue000"
CARD = rf"(?<![0-9{_JOINT}])[0-9][0-9{_JOINT}]{{11,}}+"
_END = r"(?=[\x20\x09-\x0D\"'.,;:)\]]|$)"
_TOKEN = rf"[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+{_END}"
_SHORT = rf"[A-Za-z_-]*+(?:[0-9][A-Za-z_-]*+){{1,5}}+(?![0-9]){_END}"
_START = r"(?<![^\x20\x09-\x0D\"'=:(\[])"
CANDIDATE = rf"{_START}(?:{_SHORT}(?:[\x20.]{_SHORT}|\)\x20{_TOKEN})*+|{_TOKEN})"
TOKEN = _START + _TOKEN
KEY = r"^(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}$"
WINDOW = 200
BROADCAST_PATTERNS = 200_000
_WORDS = r"[\x20\x09-\x0D]+|(?<=[=:])(?=[^\x20\x09-\x0D=:/])"


def _found(text: Column, pattern: str, shown: Column | None = None) -> Column:
    """Array of (start, end, value) for all matches; ``shown`` gives the values where ``text`` is a rewritten copy."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(h).alias("size")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    laid = F.aggregate(
        sizes, empty,
        lambda t, s: F.struct((t["at"] + s["gap"] + s["size"]).alias("at"), F.concat(t["spans"], F.array(F.struct((t["at"] + s["gap"]).alias("start"), (t["at"] + s["gap"] + s["size"]).alias("end")))).alias("spans")),
        lambda t: t["spans"],
    )
    return F.transform(laid, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text if shown is None else shown, s["start"] + 1, s["end"] - s["start"]).alias("value")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))
    each = F.transform(places, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda t, d: t + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (start, end, place of the kind in ``KINDS``, value), ordered by start and kind, for a text that isn't null."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    plain = F.regexp_replace(F.translate(text, _JOINT, "\ue001"), r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)
    small = lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(999)) <= 255)
    emails = F.when(F.contains(text, F.lit("@")), _found(text, EMAIL)).otherwise(none)
    ips = F.when(F.rlike(text, F.lit(IP)), F.filter(_found(text, IP), lambda s: F.forall(F.split(s["value"], r"\."), small))).otherwise(none)
    cards = F.filter(_found(plain, CARD, text), lambda s: F.length(_digits(s["value"])).between(12, 19) & luhn(_digits(s["value"])))
    cards = F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), cards).otherwise(none)
    phones = F.filter(_found(text, PHONE), lambda s: F.length(_digits(s["value"])).between(9, 15))
    phones = F.when(F.contains(text, F.lit("+")), phones).otherwise(none)
    marked = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), s["value"].alias("value"))
    each = [F.transform(found, marked(k)) for k, found in enumerate((emails, ips, cards, phones))]
    # start, then kind: spans of one kind don't overlap, so the end never decides
    return F.array_sort(F.concat(*each), lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(a["kind"] - b["kind"])).cast("int"))


def _once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _patterns(text: Column, start: Column) -> Column:
    """The word before a place, and the two words before it; none if the place is inside a word."""
    before = F.lower(F.substring(text, F.greatest(start - (WINDOW - 1), F.lit(1)), F.least(start, F.lit(WINDOW))))
    pieces = F.split(before, _WORDS, -1)
    # the first piece of a full window may be a part of a word
    whole = _once(pieces, lambda p: F.when(start > WINDOW, F.slice(p, F.lit(2), F.size(p))).otherwise(p))
    none = F.array().cast("array<string>")

    def words(p: Column) -> Column:
        last = F.element_at(p, -1)
        opened = F.slice(p, F.lit(1), F.size(p) - 1)
        return F.filter(F.when(F.size(p) == 0, none).when(F.rlike(last, F.lit(r"^[\"'(\[]*$")), opened).when(F.rlike(last, F.lit("[=:]$")), p).otherwise(none), lambda w: w != "")

    def patterns(w: Column) -> Column:
        one, two = F.get(w, F.size(w) - 1), F.get(w, F.size(w) - 2)
        return F.filter(F.array(one, F.concat(two, F.lit(" "), one)), lambda x: x.isNotNull())

    return _once(_once(whole, words), patterns)


def _uses(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, uses``: how often each of ``patterns(pattern)`` is followed by a word, over all texts."""
    n = patterns.count()
    asked = patterns.select("pattern", F.substring_index("pattern", " ", -1).alias("b"), F.when(F.contains("pattern", F.lit(" ")), F.substring_index("pattern", " ", 1)).alias("first"))
    words = texts.select(F.split(F.lower("text"), _WORDS, -1).alias("w"))
    ahead = F.concat(F.array(F.lit("")), F.col("w"))
    triples = words.select(F.inline(F.arrays_zip(ahead.alias("a"), F.col("w").alias("b"), F.slice("w", F.lit(2), F.size("w")).alias("c")))).toDF("a", "b", "c").where("c <> ''")
    met = triples.join(F.broadcast(asked) if n <= BROADCAST_PATTERNS else asked, "b").where("first is null or first = a")
    return met.groupBy("pattern").agg(F.count("*").alias("uses"))


def spans_string(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal(documents: DataFrame, support: int = 4, confidence: float = 0.75, rounds: int = 3) -> DataFrame:
    """Columns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added, base, added`` of ``documents(doc_id, text, ...)``.

    ``base`` and ``added`` are arrays of (start, end, kind, value); the counts by kind are of ``base``.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.withColumn("row", F.monotonically_increasing_id()).withColumn("base", base_spans(F.col("text")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = lambda form, some: F.when(F.rlike("text", F.lit(some)), F.filter(_found(F.col("text"), form), lambda s: F.length(_digits(s["value"])) >= MIN_DIGITS)).otherwise(none)
    apart = lambda spans, others: F.filter(spans, lambda t: ~F.exists(others, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.withColumn("joined", apart(found(CANDIDATE, r"[0-9][A-Za-z0-9_-]*+\)?[\x20.]?[A-Za-z_-]*+[0-9]"), F.col("base")))
    # tokens whose longer span runs into a seed count alone
    rows = rows.withColumn("tokens", F.concat("joined", apart(apart(found(TOKEN, r"[0-9][A-Za-z0-9_-]{3}"), F.col("base")), F.col("joined"))))
    mention = lambda s, kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.cast("int").alias("kind"), s["value"].alias("value"), _patterns(F.col("text"), s["start"]).alias("patterns"))
    seeds = F.transform("base", lambda s: mention(s, s["kind"]))
    others = F.transform("tokens", lambda s: mention(s, F.when(F.rlike(s["value"], F.lit(KEY)), _BASE)))
    rows = stash(rows.select("doc_id", "row", "base", F.concat(seeds, others).alias("mentions")), "mentions")

    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = mentions.groupBy("pattern", "value").agg(F.min("kind").alias("kind"), F.count("*").alias("mentions"))
    edges = stash(edges, "edges")
    known = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions")).where(F.col("n") >= support)
    known = stash(known, "known")
    uses = _uses(texts, known.select("pattern"))
    plain = F.greatest(F.coalesce("uses", F.lit(0)) - F.col("mentions"), F.lit(0))
    patterns = stash(known.join(uses, "pattern", "left").select("pattern", "n", "mentions", (F.col("n") + plain).alias("places")), "patterns")
    small = join_spread(edges.select("pattern", "value", "kind"), patterns.select("pattern", F.col("n").alias("copies")), ["pattern"], "copies", edges.count())
    old, edges = edges, stash(small, "edges")
    drop(old, known)
    total = edges.count()
    scores = edges.groupBy("value").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("score"), F.min("kind").alias("as"), F.count("*").alias("copies"))
    scores, sure = stash(scores, "scores"), None
    for _ in range(rounds):
        told = join_spread(edges.select("pattern", "value"), scores, ["value"], "copies", total)
        votes = [F.count_if(F.col("as") == k).alias(f"v{k}") for k in range(len(KINDS))]
        judged = told.groupBy("pattern").agg(F.sum("score").alias("held"), *votes).join(patterns, "pattern")
        judged = judged.withColumn("belief", F.col("held") / F.col("places")).where(F.col("belief") >= confidence)
        most = F.greatest(*[f"v{k}" for k in range(len(KINDS))])
        drop(*([sure] if sure is not None else []))
        sure = stash(judged.select("pattern", "belief", "n", "mentions", F.coalesce(*[F.when(F.col(f"v{k}") == most, k) for k in range(len(KINDS))]).alias("of")), "sure")
        lifted = join_spread(edges.select("pattern", "value"), sure.select("pattern", "belief", "of", F.col("n").alias("copies")), ["pattern"], "copies", total)
        lifted = lifted.groupBy("value").agg(F.max(F.struct("belief", (-F.col("of")).alias("order"))).alias("best"))
        lifted = lifted.select("value", F.col("best.belief").alias("belief"), (-F.col("best.order")).alias("of"))
        better = F.coalesce(F.col("belief") > F.col("score"), F.lit(False))
        raised = scores.join(lifted, "value", "left").select("value", F.when(better, F.col("belief")).otherwise(F.col("score")).alias("score"), F.when(better, F.col("of")).otherwise(F.col("as")).alias("as"), "copies")
        old, scores = scores, stash(raised, "scores")
        drop(old)
    open_ = mentions.where(f"kind is null or kind = {_BASE}")
    new = join_spread(open_.drop("kind"), sure.select("pattern", "belief", "of", F.col("mentions").alias("copies")), ["pattern"], "copies", mentions.count())
    new = new.groupBy("row", "start", "end", "value").agg(F.max(F.struct("belief", (-F.col("of")).alias("order"))).alias("best"))
    new = new.select("row", F.struct("start", "end", (-F.col("best.order")).alias("kind"), "value").alias("s")).groupBy(F.col("row").alias("_row")).agg(F.collect_list("s").alias("added"))
    new = stash(new, "added")
    drop(edges, patterns, scores, sure)
    rows = rows.drop("mentions").join(new, rows.row == new._row, "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    added = F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>"))
    every = F.array_sort(F.concat("base", added), lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(a["kind"] - b["kind"])).cast("int"))
    return rows.select(
        "doc_id", *map(count, range(_BASE)), F.sha2(spans_string(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_string(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"), F.size(added).cast("long").alias("n_added"), "base", added.alias("added"),
    )
